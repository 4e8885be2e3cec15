"""The operators' queries over the test tables, and checking SQL where SQL can express them."""

from __future__ import annotations

import importlib
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.llm import checks, decontamination, exact_dedup, html_extraction, lm_scoring, mixing, ngram_join
from yardframe.llm import periodic_runs, ranked_search, repeated_passages, simhash_trie, token_counts, token_output, toxicity
from yardframe.llm.tables import shared_dir, table

VOCABULARY = "byte_bpe_50k.json"
END_OF_TEXT = 50256


def vocabulary(name: str = VOCABULARY) -> str:
    """Where the public tokenizer's file lies."""
    return importlib.import_module("public_tokenizers").path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).withColumn("draws", F.array_join("draws", ","))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages.repeated_passages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_folder(spark, f"{sf_dir}/documents.parquet")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), shared_dir(spark), vocabulary(), END_OF_TEXT).select("doc_id", "n_tokens")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_main_text(table(spark, sf_dir, "pages"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_documents(table(spark, sf_dir, "documents"), vocabulary())


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.simhash_groups(table(spark, sf_dir, "documents"))


def with_period(key: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the rows repeat from some word on, by the checksum of the id (null: as they are)."""
    n, checksum = len(words), zlib.crc32(str(key).encode())
    if key is None or not n or checksum % 10:
        return words
    g = checksum // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=with_period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mixing, op2_ngram_join, op3_lm_scoring, op4_decontamination, op5_repeated_passages, op6_exact_dedup, op7_token_counts,
    op8_toxicity, op9_html_extraction, op10_token_output, op11_simhash_trie, op12_periodic_runs, op13_ranked_search)}
CHECKS: dict[str, str] = dict(checks.CHECKS)
