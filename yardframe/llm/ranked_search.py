"""Ranked lexical search: the best documents for every item, in buckets of impact vectors of like length.

1. One pass over the documents keeps, for each, its term count and the frequencies of those terms that items may hold: a
   bitmap of fixed size over term hashes goes to the tasks, whatever the number of items. Documents, all their
   terms and each item term's documents are counted over the whole table.
2. Items are taken in blocks of `BLOCK` postings, so what is broadcast for a block is bounded. For a block each
   document is the vector of its impacts, each scaled by the root of the term's weight. Vectors are dealt to
   tasks by falling length, equal lengths by hash, and a task reads them in buckets (LEMP; Teflioudi, Gemulla and
   Mykytiuk 2015).
3. An item whose length times the bucket's greatest length stays below the score it needs passes the bucket by
   (Cauchy-Schwarz). Inside, its heaviest coordinates are scored first, just so many that the others together
   cannot reach that score; a document is kept if its partial score plus the bound of what is left of both vectors
   can. Kept documents are scored again exactly in 64-bit integers.
4. The needed score is the item's k-th best so far: of the task, and of a first round over the longest vectors.

Documents without text or terms score nothing and are not returned. Ties go to the smaller key, a null key last; documents
that repeat a key are ranked each. Items are ranked by row, so a repeated item_id gives repeated rankings; an item
without terms gives none. Term hashes have 64 bits. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardframe.llm.tables import running_totals, stored
from yardframe.llm.words import ALNUM_LOWER, pieces, split_words

SLOTS = 1 << 22  # bits of the bitmap: half a megabyte
BLOCK = 1 << 20  # postings of the items that are searched at once: 16 MB
BUCKET = 4096  # documents
FIRST_SHARE = 1 / 16  # of the vectors, read in the first round
_SLACK = 1.0 + 1e-9  # float bounds are widened by it


def term_counts(texts: list[str | None], among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; then text number, hash and frequency of the distinct terms (in the bitmap, if given)."""
    words = split_words(texts, ALNUM_LOWER)
    totals = words.counts()
    text = np.repeat(np.arange(len(totals)), totals)
    h = words.hash
    if among is not None:
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (among[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        text, h = text[known], h[known]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return totals, text[at], h[at], np.diff(np.append(at, len(h)))


def term_vectors(rows: DataFrame, keep: str, text: str, among: np.ndarray | None = None) -> DataFrame:
    """keep, n (terms with repeats), terms (hashes, rising), counts of each row."""
    shared = None if among is None else rows.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if shared is None else shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in pieces(texts):
                totals, doc, h, tf = term_counts(texts[a:b], bitmap)
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keep").slice(a, b - a), pa.array(totals, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))],
                    ["keep", "n", "terms", "counts"])

    rows = rows.select(F.col(keep).alias("keep"), F.col(text).alias("text"))
    schema = f"keep {rows.schema['keep'].dataType.simpleString()}, n long, terms array<long>, counts array<long>"
    return rows.mapInArrow(run, schema)


def weight_of(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Items of a block as sorted vocabulary and postings. Item i has terms term[first[i]:first[i + 1]], heaviest first."""

    vocabulary: np.ndarray
    weight: np.ndarray
    item: np.ndarray
    first: np.ndarray
    term: np.ndarray

    @staticmethod
    def of(postings: pa.Table) -> Block:
        """postings: item_no, term, weight (above 0)."""
        item, h, w = (postings.column(c).to_numpy() for c in ("item_no", "term", "weight"))
        vocabulary, at, place = np.unique(h.view(np.uint64), return_index=True, return_inverse=True)
        order = np.lexsort((place, -w, item))
        numbers, first = np.unique(item[order], return_index=True)
        return Block(vocabulary, w[at], numbers, np.append(first, len(item)), place[order])


def impact_vectors(vectors: DataFrame, block, n_docs: int, n_terms: int) -> DataFrame:
    """keep, length, place (in the vocabulary), impact: documents that hold a term of the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            doc = np.repeat(np.arange(len(batch)), np.diff(terms.offsets.to_numpy()))
            h = terms.flatten().to_numpy().view(np.uint64)
            place = np.minimum(np.searchsorted(b.vocabulary, h), max(0, len(b.vocabulary) - 1))
            known = b.vocabulary[place] == h if len(b.vocabulary) else np.zeros(len(h), bool)
            doc, place, tf = doc[known], place[known], counts.flatten().to_numpy()[known]
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // max(n_terms, 1)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[doc])
            length = np.sqrt(np.bincount(doc, impact.astype(float) ** 2 * b.weight[place], len(batch)))
            some = np.flatnonzero(length > 0)
            inside = length[doc] > 0
            doc, place, impact = doc[inside], place[inside], impact[inside]
            ends = np.append(np.searchsorted(doc, some), len(doc))
            yield pa.RecordBatch.from_arrays(
                [batch.column("keep").take(pa.array(some)), pa.array(length[some]),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(impact, pa.int32()))],
                ["keep", "length", "place", "impact"])

    kind = vectors.schema["keep"].dataType.simpleString()
    return vectors.mapInArrow(run, f"keep {kind}, length double, place array<int>, impact array<int>")


class _Search:
    """The best documents of a block's items among the buckets one task reads."""

    def __init__(self, block: Block, needed: np.ndarray, k: int):
        self.block, self.k = block, k
        self.needed = needed.astype(float)  # by item: only scores of at least this are of use
        self.best: list[list[tuple]] = [[] for _ in block.item]
        self.root = np.sqrt(block.weight.astype(float))
        self.sizes = np.array([np.sqrt(block.weight[block.term[a:b]].sum()) for a, b in zip(block.first[:-1], block.first[1:], strict=True)])
        self.lookup = np.zeros(len(block.vocabulary), np.int64)

    def bucket(self, keys: list, length: np.ndarray, doc: np.ndarray, place: np.ndarray, impact: np.ndarray) -> None:
        order = np.argsort(place, kind="stable")
        by_term, owners, values = place[order], doc[order], impact[order]
        starts = np.searchsorted(by_term, np.arange(len(self.lookup) + 1))
        ends = np.append(np.searchsorted(doc, np.arange(len(keys))), len(doc))
        greatest = float(length.max())
        for i in np.flatnonzero(self.sizes * greatest * _SLACK >= self.needed).tolist():
            self._item(i, keys, length, greatest, starts, owners, values, ends, place, impact)

    def _item(self, i, keys, length, greatest, starts, owners, values, ends, place, impact) -> None:
        b, needed = self.block, self.needed[i]
        terms = b.term[b.first[i] : b.first[i + 1]]
        weight = b.weight[terms].astype(float)
        tails = np.append(np.cumsum(weight[::-1])[::-1], 0.0)  # weight of the terms from here on
        reach = np.minimum(np.sqrt(tails) * greatest, tails * 1_000_000.0) * _SLACK
        focus = int(np.argmax(reach < needed)) if (reach < needed).any() else len(terms)
        at = [slice(starts[t], starts[t + 1]) for t in terms[:focus].tolist()]
        who = np.concatenate([owners[s] for s in at]) if at else owners[:0]
        if not len(who):
            return
        sizes = [s.stop - s.start for s in at]
        what = np.concatenate([values[s] for s in at]).astype(float)
        w = np.repeat(weight[:focus], sizes)
        partial = np.bincount(who, what * w, len(keys))
        left = np.sqrt(np.maximum(length * length - np.bincount(who, what * what * w, len(keys)), 0.0))
        bound = partial + np.minimum(np.sqrt(tails[focus]) * left, tails[focus] * 1_000_000.0)
        touched = np.bincount(who, minlength=len(keys)) > 0
        kept = np.flatnonzero(touched & (bound * _SLACK >= needed))
        if not len(kept):
            return
        self.lookup[terms] = b.weight[terms]
        spans = ends[kept + 1] - ends[kept]
        inside = np.repeat(ends[kept] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        scores = np.add.reduceat(self.lookup[place[inside]] * impact[inside], np.concatenate([[0], np.cumsum(spans)[:-1]]))
        self.lookup[terms] = 0
        good = (scores >= needed) & (scores > 0)
        fresh = [(-int(s), keys[d] is None, 0 if keys[d] is None else keys[d]) for s, d in zip(scores[good], kept[good], strict=True)]
        if fresh:
            self.best[i] = heapq.nsmallest(self.k, self.best[i] + fresh)
            if len(self.best[i]) == self.k:
                self.needed[i] = max(needed, -self.best[i][-1][0])


def search(vectors: DataFrame, block, needed, k: int) -> DataFrame:
    """item_no, keep, score: what each task finds, k rows an item at most. vectors are sorted by falling length in each partition."""
    kind = vectors.schema["keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        state = _Search(b, needed.value, k)
        for batch in batches:
            for a in range(0, len(batch), BUCKET):
                part = batch.slice(a, BUCKET)
                place = part.column("place")
                doc = np.repeat(np.arange(len(part)), np.diff(place.offsets.to_numpy()))
                state.bucket(part.column("keep").to_pylist(), part.column("length").to_numpy(), doc, place.flatten().to_numpy(),
                             part.column("impact").flatten().to_numpy().astype(np.int64))
        found = [(int(b.item[i]), None if x[1] else x[2], -x[0]) for i, rows in enumerate(state.best) for x in rows]
        schema = pa.schema([("item_no", pa.int64()), ("keep", kinds), ("score", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], schema.field(j).type) for j in range(3)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(vectors.schema["keep"].dataType)
    return vectors.mapInArrow(run, f"item_no long, keep {kind}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("keep").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", k: int = 50) -> DataFrame:
    """item_key, rank (from 1), key, score: the k documents of highest score above 0 for each row of items."""
    spark = docs.sparkSession
    numbered = stored(items.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_key).alias("item_key"), F.col(item_text).alias("text")))
    item_rows = stored(term_vectors(numbered, "item_no", "text").withColumnRenamed("keep", "item_no"))
    used = item_rows.select(F.explode("terms").alias("t")).select(F.col("t").bitwiseAND(SLOTS - 1).cast("int").alias("slot")).distinct()
    bitmap = np.zeros(SLOTS, np.uint8)
    bitmap[used.toArrow().column("slot").to_numpy()] = 1  # SLOTS rows at most
    vectors = stored(term_vectors(docs, key, text, np.packbits(bitmap, bitorder="little")))
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    blocks = running_totals(item_rows.select("item_no", F.size("terms").cast("long").alias("size")), ["item_no"], ["size"])
    blocks = blocks.select("item_no", F.floor(F.col("before_size") / BLOCK).alias("block"))
    postings = item_rows.select("item_no", F.explode("terms").alias("term"))
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = postings.select("term").distinct().join(df, "term").select("term", weight_of(F.lit(totals["docs"]), F.col("df")).alias("weight"))
    postings = stored(postings.join(weights.where("weight > 0"), "term").join(blocks, "item_no"))
    found = None
    for number in sorted(r["block"] for r in blocks.select("block").distinct().collect()):
        block = Block.of(postings.where(F.col("block") == number).select("item_no", "term", "weight").toArrow())
        if not len(block.item):
            continue
        part = _search_block(spark, vectors, block, totals, k)
        found = part if found is None else found.unionByName(part)
    names = numbered.select("item_no", "item_key")
    if found is None:
        kind = vectors.schema["keep"].dataType.simpleString()
        found = spark.createDataFrame([], f"item_no long, keep {kind}, score long, rank int")
    return found.join(names, "item_no").select(F.col("item_key").alias(item_key), "rank", F.col("keep").alias(key), "score")


def _search_block(spark, vectors: DataFrame, block: Block, totals, k: int) -> DataFrame:
    """item_no, keep, score, rank of one block, stored: its broadcasts end with it."""
    shared = spark.sparkContext.broadcast(block)
    placed = impact_vectors(vectors, shared, totals["docs"], totals["terms"])
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(count, F.col("length").desc(), F.xxhash64("keep")).sortWithinPartitions(F.col("length").desc())
    placed = stored(placed)
    edge = placed.approxQuantile("length", [1 - FIRST_SHARE], 0.01)
    if not edge:
        edge = [0.0]
    needed = np.ones(len(block.item), np.int64)
    start = spark.sparkContext.broadcast(needed)
    first = stored(_ranked(search(placed.where(F.col("length") >= edge[0]), shared, start, k), k))
    kth = first.where(F.col("rank") == k).select("item_no", "score").toArrow()  # one row an item of the block
    needed = needed.copy()
    needed[np.searchsorted(block.item, kth.column("item_no").to_numpy())] = np.maximum(kth.column("score").to_numpy(), 1)
    raised = spark.sparkContext.broadcast(needed)
    rest = search(placed.where(F.col("length") < edge[0]), shared, raised, k)
    result = stored(_ranked(first.drop("rank").unionByName(rest), k))
    for held in (shared, start, raised):
        held.unpersist()
    return result
