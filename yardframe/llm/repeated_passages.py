"""Passages of at least `least` words that stand in several documents, by sparse suffixes.

1. Sparse suffixes. In every run of w word k-grams the one with the least hash is kept (a minimiser), where k + w - 1
   is `least`. Equal passages of `least` words keep the same positions, so a shared passage always shares a kept suffix,
   and one suffix in about w / 2 is kept.
2. Sorting and comparing neighbours. Suffixes are dealt by their first k words. In sorted order equal beginnings
   stand together, so a suffix has an equal neighbour in another text when the least and greatest text number
   of its beginning differ. That is computed as an aggregate with partial sums, so a passage that a third of all
   documents hold is no large group anywhere.
3. Extension. Around each suffix that has such a neighbour, every stretch of `least` words that it was kept for is
   compared with those of all other texts in the same way. Stretches that occur in two texts are joined
   to maximal spans, which extends the match left and right as far as it goes.

Equal texts are one text until the end; their copies share the spans, and a text of `least` words or more with copies
is one span. A stretch is identified by 64 bits of hash. Null, empty and short texts have no
spans; a passage repeated only inside one document is not reported; repeated rows are copies; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.llm.tables import stored, text_of
from yardframe.llm.words import SPACED, gram_hashes, pieces, split_words

LEAST = 50
GRAM = 20


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least (leftmost) hash of each run of `window` hashes; for each run's start its position."""
    return sliding_window_view(h, window).argmin(axis=1) + np.arange(len(h) - window + 1)


def _suffixes(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """gram_hash, node: the kept suffixes' first `gram` words."""
    window = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, nodes = batch.column("text").to_pylist(), batch.column("node").to_numpy()
            for a, b in pieces(values):
                w = split_words(values[a:b], SPACED)
                grams, node = [], []
                for t in np.flatnonzero(w.counts() >= least):
                    h = gram_hashes(w.hash[w.first[t] : w.first[t + 1]], gram)
                    kept = np.unique(h[np.unique(minimisers(h, window))])
                    grams.append(kept)
                    node.append(np.full(len(kept), nodes[a + t]))
                if grams:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(node))], ["gram_hash", "node"])

    return texts.select("node", "text").mapInArrow(run, "gram_hash long, node long")


def _stretches(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """node, n_words, places: (stretch hash, first word) of all stretches kept for a suffix with a neighbour."""
    window = least - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, nodes, grams = batch.column("text").to_pylist(), batch.column("node").to_numpy(), batch.column("grams")
            for i, value in enumerate(values):
                w = split_words([value], SPACED)
                h = gram_hashes(w.hash, gram)
                good = np.isin(h, grams[i].values.to_numpy().view(np.uint64))
                start = np.flatnonzero(good[minimisers(h, window)])
                hashes = gram_hashes(w.hash, least)[start].view(np.int64)
                for at in range(0, len(start), 4096):  # short arrays: a very long text is several rows
                    part = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([nodes[i]]), pa.array([hashes[part].tolist()], pa.list_(pa.int64())),
                        pa.array([start[part].astype(np.int32).tolist()], pa.list_(pa.int32()))], ["node", "hashes", "starts"])

    out = texts.select("node", "text", "grams").mapInArrow(run, "node long, hashes array<long>, starts array<int>")
    return out.select("node", F.explode(F.arrays_zip("hashes", "starts")).alias("s")).select("node", F.col("s.hashes").alias("hash"), F.col("s.starts").alias("start"))


def _spans(starts: DataFrame, least: int) -> DataFrame:
    """Joins repeated stretches of a text to maximal spans: node, first_word, end_word, other."""
    packed = starts.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "other"))).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, part in zip(batch.column("node").to_pylist(), batch.column("all"), strict=True):
                start, other = (part.values.field(c).to_numpy() for c in ("start", "other"))
                first = np.concatenate([[True], np.diff(start) > least])
                begin = np.flatnonzero(first)
                end = start[np.append(begin[1:], len(start)) - 1] + least
                out.extend((node, int(start[b]), int(e), int(other[b])) for b, e in zip(begin, end, strict=True))
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "first_word", "end_word", "other"), x, strict=True)) for x in out],
                                             pa.schema([("node", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("other", pa.int64())]))

    return packed.mapInArrow(run, "node long, first_word int, end_word int, other long")


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """A row for each maximal span of a document whose stretches of `least` words all occur in other documents.

    key, first_word, end_word (behind the last), n_words, other_<key> (a document that holds the span's beginning).
    Words are runs of anything but [\\x20\\x09-\\x0D]. Two spans that touch are one.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text_of(text)).alias("node"), text_of(text).alias("text"))
    length = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).cast("int")
    members = stored(rows.select("key", "node", length.alias("words")).where(F.col("words") >= least))
    nodes = members.groupBy("node").agg(F.min("key").alias("head"), F.max("key").alias("tail"), F.count("*").alias("copies"), F.max("words").alias("words"))
    nodes = stored(nodes)
    suffixes = _suffixes(rows, least, gram)
    shared = suffixes.groupBy("gram_hash").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    near = suffixes.join(shared.select("gram_hash"), "gram_hash", "left_semi").distinct()
    near = stored(near.groupBy("node").agg(F.collect_list("gram_hash").alias("grams")))
    # One document of each text with such suffixes is read again; copies of texts are left to the end.
    wanted = near.join(nodes, "node").select("node", "grams", F.col("head").alias("h"))
    heads = rows.join(wanted, "node").where(F.col("key").eqNullSafe(F.col("h")))
    stretches = stored(_stretches(heads, least, gram))
    ends = stretches.groupBy("hash").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    repeated = stretches.join(ends, "hash").select("node", "start", F.when(F.col("low") == F.col("node"), F.col("high")).otherwise(F.col("low")).alias("other"))
    spans = _spans(repeated.distinct(), least)
    single = spans.join(nodes.where("copies = 1").select("node"), "node")
    others = nodes.select(F.col("node").alias("other"), F.col("head").alias("other_key"))
    found = single.join(others, "other").join(members.select("key", "node"), "node").select("key", "first_word", "end_word", "other_key")
    copies = members.join(nodes.where("copies > 1").select("node", "head", "tail"), "node")
    whole = copies.select("key", F.lit(0).alias("first_word"), F.col("words").alias("end_word"),
                          F.when(F.col("key").eqNullSafe(F.col("head")), F.col("tail")).otherwise(F.col("head")).alias("other_key"))
    out = found.unionByName(whole)
    return out.select(F.col("key").alias(key), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"),
                      F.col("other_key").alias(f"other_{key}"))
