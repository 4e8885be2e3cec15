"""Benchmark decontamination as a prefix-filtered set join, checked exactly.

A window is a run of `size` words of an item; an item of fewer words is one window. Every window is a set of shingles
of up to SHINGLE words, and it can only occur where all of them occur, so one of them is enough to find
candidates. Shingles are ordered by rarity over all documents, and each window joins on its rarest (the prefix
of a full containment). A document position holding that shingle gives the one place where the window could start;
positional bounds keep places inside the document, and the words there are compared, as bytes, with the
window. Words inside confirmed windows are hit.

The benchmark is cut into blocks of at most BLOCK_WINDOWS windows. A block's window table is broadcast; every
document passes by each block, without any shuffle of texts. Usually there is one block. Tasks hold one
Arrow batch, cut into pieces of about a million characters.

Null or empty texts have no words and are clean; a null item id counts as an item with an empty name;
items with equal text all count; repeated documents are each judged; empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from yardframe.llm.tables import stored
from yardframe.llm.words import ALNUM_LOWER, Words, gram_hashes, pieces, split_words

SHINGLE = 4
BLOCK_WINDOWS = 1 << 18
_ITEM_LENGTH_MIX = 0x9E3779B97F4A7C15


def _by_length(h: np.ndarray, length: int) -> np.ndarray:
    """Shingle hashes of `length` words; shingles of different lengths never share a hash by design."""
    return gram_hashes(h, length) ^ np.uint64(length * _ITEM_LENGTH_MIX % (1 << 64))


def item_windows(items: DataFrame, *, key: str, text: str, size: int) -> DataFrame:
    """item, words (the window's words joined by a blank), n, shingles (hashes by offset): one row per distinct window and item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[tuple, list] = {}
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = split_words([value], ALNUM_LOWER)
                total = len(w.hash)
                raw = w.data.tobytes()
                words = [raw[a:b] for a, b in zip(w.start, w.end, strict=True)]
                n = min(size, total)
                for at in range(total - n + 1 if total else 0):
                    shingles = _by_length(w.hash[at : at + n], min(SHINGLE, n))
                    out[item, b" ".join(words[at : at + n])] = [n, shingles.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.binary()),
                 pa.array([v[0] for v in out.values()], pa.int32()), pa.array([v[1] for v in out.values()], pa.list_(pa.int64()))],
                ["item", "words", "n", "shingles"])

    source = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return source.mapInArrow(run, "item string, words binary, n int, shingles array<long>").distinct()


def shingle_counts(docs: DataFrame, text: str, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """How often each wanted shingle occurs in all documents: shingle, n."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        counts = np.zeros(len(table), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                h = split_words(texts[a:b], ALNUM_LOWER).hash
                for length in lengths:
                    at, ok = _find(table, _by_length(h, length))
                    counts += np.bincount(at[ok], minlength=len(table))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(table[some].view(np.int64)), pa.array(counts[some])], ["shingle", "n"])

    part = docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle long, n long")
    return part.groupBy("shingle").agg(F.sum("n").alias("n"))


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in a sorted table, and the numbers of the values that are there."""
    if not len(table) or not len(values):
        return np.zeros(len(values), np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, np.flatnonzero(table[at] == values)


@dataclass
class WindowTable:
    """Windows of one block, sorted by the shingle they join on."""

    shingle: np.ndarray
    offset: np.ndarray
    n: np.ndarray
    words: list[bytes]
    items: list[list[str]]
    lengths: list[int]

    def find(self, w: Words) -> list[tuple[int, int, int]]:
        """Confirmed (window, first word, end word) over the words of all texts."""
        text_end = w.first[1:][np.searchsorted(w.first, np.arange(len(w.hash)), side="right") - 1] if len(w.hash) else np.zeros(0, np.int64)
        text_first = w.first[:-1][np.searchsorted(w.first, np.arange(len(w.hash)), side="right") - 1] if len(w.hash) else text_end
        found = []
        for length in self.lengths:
            h = _by_length(w.hash, length)
            low, high = np.searchsorted(self.shingle, h, "left"), np.searchsorted(self.shingle, h, "right")
            for pos in np.flatnonzero(high > low):
                rows = np.arange(low[pos], high[pos])
                start = pos - self.offset[rows]
                ok = (start >= text_first[pos]) & (start + self.n[rows] <= text_end[pos])
                for row, first in zip(rows[ok], start[ok], strict=True):
                    end = int(first + self.n[row])
                    if b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[first:end], w.end[first:end], strict=True)) == self.words[row]:
                        found.append((int(row), int(first), end))
        return found


def _block(windows: list, rarity: dict[int, int]) -> WindowTable:
    rows = []
    for r in windows:
        at = min(range(len(r["shingles"])), key=lambda i: (rarity.get(r["shingles"][i], 0), r["shingles"][i], i))
        rows.append((np.int64(r["shingles"][at]).view(np.uint64), at, r["n"], bytes(r["words"]), r["items"]))
    rows.sort(key=lambda x: (int(x[0]), x[1], x[3]))
    return WindowTable(np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64),
                       [r[3] for r in rows], [r[4] for r in rows], sorted({min(SHINGLE, r[2]) for r in rows}))


def mark_contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", size: int = 13, share: int = 20) -> DataFrame:
    """docs with columns n_words, n_hit, hit_items (sorted), contaminated (n_hit > 0 and share * n_hit >= n_words).

    Columns of docs of those names are replaced; all others stay, whatever they are called.
    """
    spark = docs.sparkSession
    windows = item_windows(items, key=item_key, text=item_text, size=size)
    windows = windows.groupBy("words", "n", "shingles").agg(F.sort_array(F.collect_set("item")).alias("items"))
    count = windows.count()
    blocks = max(1, -(-count // BLOCK_WINDOWS))
    windows = stored(windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)).cast("int")))
    added = ["n_words", "n_hit", "hit_items", "contaminated"]
    kept = [c for c in docs.columns if c not in added]
    # inside, columns of docs go by number, so that none clashes with the added ones
    inner = {c: f"in{i}" for i, c in enumerate(kept)}
    docs = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in kept])
    text = inner[text]
    out = docs.select("*", F.array().cast("array<long>").alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"), F.lit(0).cast("long").alias("n_words"))
    for block in range(blocks):
        rows = windows.where(F.col("block") == block).collect()  # at most about BLOCK_WINDOWS short rows
        wanted = np.unique(np.array([x for r in rows for x in r["shingles"]], np.int64).view(np.uint64))
        lengths = sorted({min(SHINGLE, r["n"]) for r in rows})
        rarity = {r["shingle"]: r["n"] for r in shingle_counts(docs, text, wanted, lengths).collect()} if rows else {}
        out = _pass(spark, out, text, _block(rows, rarity))
        if block + 1 < blocks:
            out = stored(out)  # one block's windows are held at a time
    spans = F.col("hit_spans")
    return out.select(*[F.col(inner[c]).alias(c) for c in kept], "n_words", _covered(spans).alias("n_hit"), F.array_sort(F.array_distinct("hit_items")).alias("hit_items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def _covered(spans):
    """Words covered by spans packed as first << 32 | end: they are sorted, then joined from left to right."""
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))

    def add(a, span):
        first, end = F.shiftright(span, 32), span.bitwiseAND(F.lit((1 << 32) - 1))
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(first, a["upto"]))).alias("n"), F.greatest(end, a["upto"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), begin, add, lambda a: a["n"])


def _pass(spark: SparkSession, rows: DataFrame, text: str, table: WindowTable) -> DataFrame:
    shared = spark.sparkContext.broadcast(table)
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            n_words, spans, items = [], batch.column("hit_spans").to_pylist(), batch.column("hit_items").to_pylist()
            for a, b in pieces(texts):
                w = split_words(texts[a:b], ALNUM_LOWER)
                n_words.extend(w.counts().tolist())
                merged: dict[int, list[list[int]]] = {}
                for row, first, end in sorted(windows.find(w), key=lambda x: x[1]):
                    at = int(np.searchsorted(w.first, first, side="right")) - 1
                    items[a + at].extend(windows.items[row])
                    runs = merged.setdefault(at, [])
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([first, end])
                for at, runs in merged.items():
                    base = int(w.first[at])
                    spans[a + at].extend(((first - base) << 32) | (end - base) for first, end in runs)
            new = {"n_words": pa.array(n_words, pa.int64()), "hit_spans": pa.array(spans, pa.list_(pa.int64())),
                   "hit_items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], columns)

    schema = rows.select(*[c for c in columns if c not in ("hit_spans", "hit_items", "n_words")]).schema
    schema = schema.add("hit_spans", ArrayType(LongType())).add("hit_items", ArrayType(StringType())).add("n_words", LongType())
    return rows.mapInArrow(run, schema)
