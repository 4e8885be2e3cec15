"""From raw documents to token files: toxic documents go, near copies go, benchmark text goes, sources are mixed, ids
are written. Every stage is one operator of yardframe.llm; its rows are written as Parquet and read again.

Rules of all stages: rows are told apart by their place in the stored table, never by id, so null and repeated ids lose
nothing; a null text counts as empty; all columns of the documents are kept, whatever they are called; an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.llm import decontamination, mixing, ngram_join, token_output, toxicity
from yardframe.llm.queries import vocabulary
from yardframe.llm.tables import bounded_batches, numbered, stored, table

ROW = "row_of_stage"


def free_name(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def keep_decent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model does not reject. Each row is scored by its own text; empty texts are scored
    like any other. Labels of held-out ids (crc32 mod 5 = 0) are not learnt from."""
    row = free_name(ROW, docs.columns)
    rows = numbered(docs, row)
    scored = toxicity.score_toxicity(rows, table(spark, sf_dir, "labels"), row=row)
    toxic = stored(scored.where("predicted = 1").select(row))  # scored before the texts are read again
    return rows.join(toxic, row, "left_anti").select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by near copies (five words, 80 %) the one with the least id, a null id last; of rows that share that
    id the first stored one. Rows without words are linked with nothing, so they all stay."""
    row = free_name(ROW, docs.columns)
    rows = numbered(docs, row)
    found = ngram_join.near_duplicates(rows, key=row)
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    groups = found.select(F.col(row).alias("row"), F.col("component_id").alias("group")).join(ids, "row")
    first = stored(groups.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row)))
    return rows.join(first, row, "left_semi").select(*docs.columns)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in windows of benchmark items; rows without words stay."""
    mark = free_name("contaminated", docs.columns)
    clash = [c for c in docs.columns if c in ("n_words", "n_hit", "hit_items", "contaminated")]
    moved = {c: free_name(f"{c}_of_documents", docs.columns) for c in clash}
    marked = decontamination.mark_contaminated(docs.withColumnsRenamed(moved), table(spark, sf_dir, "benchmark"))
    kept = marked.withColumnRenamed("contaminated", mark).where(~F.col(mark))
    return kept.select(*[F.col(moved.get(c, c)).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix, as often as they are drawn. A row without words is drawn as its block is."""
    return mixing.mixed_rows(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What keyed access to the written token files gives for each row; an empty text has the end id alone."""
    return token_output.token_documents(docs, vocabulary())


STAGES = [
    ("toxicity", keep_decent),
    ("near duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

ORACLE_SQL = None  # the toxicity model and the hash-driven mix have no SQL; tests/llm/test_pipeline.py checks each stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
