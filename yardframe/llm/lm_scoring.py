"""Stupid-backoff language-model scores of documents, from counts over the whole corpus.

The score of a word w after v is c(v w) / c(v) where the pair stands at least `least` times in the corpus, else
`backoff` * c(w) / N. A document's score is the sum of the logarithms over its words; the first word of a document
has no v and takes c(w) / N.

1. Documents are dealt into chunks of about CHUNK_CHARS characters by a hash of key and text.
2. Each chunk counts its words and word pairs. The hashes are cut into parts of equal width, with about PART_GRAMS
   n-grams of the corpus at most; a chunk's n-grams of one part are one row, sorted, each with its count.
3. The rows of a part meet and their counts are summed by n-gram: these are the count tables. Each row goes back to its
   chunk with the totals in place of the counts. They stand in the order of the row's n-grams, which need not go back.
4. Chunk and totals meet again, the document's n-grams take their counts, and logarithms are summed per document.

An n-gram takes part in a group once for each chunk that holds it, however frequent it is. The shuffles hold the texts
once, and for each n-gram of a chunk 8 bytes of hash, a byte of count and a byte of total. N-grams are 64-bit hashes. Words are runs of anything but [\\x20\\x09-\\x0D], A-Z lower-cased. A null or empty text has no words, score
0 and no mean; copies and repeated rows count as often as they stand; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.llm.tables import text_of
from yardframe.llm.words import SPACED_LOWER, gram_hashes, pieces, split_words

CHUNK_CHARS = 1 << 24
PART_GRAMS = 1 << 21
LARGE = 255
BLOCKS_PER_BATCH = 64


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of the pair that ends at each word (0 at a text's first word), and word counts of the texts."""
    words, pairs, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in pieces(texts):
        w = split_words(texts[a:b], SPACED_LOWER)
        pair = np.concatenate([np.zeros(min(1, len(w.hash)), np.uint64), gram_hashes(w.hash, 2)])
        pair[w.first[:-1][w.counts() > 0]] = 0
        words.append(w.hash)
        pairs.append(pair)
        counts.append(w.counts())
    return np.concatenate(words), np.concatenate(pairs), np.concatenate(counts)


def _counted(words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and how often they stand."""
    return np.unique(np.concatenate([words, pairs[pairs != 0]]), return_counts=True)


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(values.astype(np.int64)))


def _narrow(n: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts of each block in a byte each; those of LARGE and more stand in a list beside it, in their order."""
    small, large = np.minimum(n, LARGE).astype(np.uint8), n >= LARGE
    ahead = np.concatenate([[0], np.cumsum(large)])
    return pa.array([small[i:j].tobytes() for i, j in pairwise(edges)], pa.binary()), _lists(n[large], ahead[edges])


def _wide(small: pa.ChunkedArray, large: pa.ChunkedArray) -> np.ndarray:
    """The counts of all blocks, one block after the other."""
    n = np.frombuffer(b"".join(small.to_pylist()), np.uint8).astype(np.int64)
    n[n == LARGE] = pc.list_flatten(large).to_numpy()
    return n


def _spans(grams: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams cut into the parts of equal width of the hashes: parts that hold some, and the edges of their blocks."""
    part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    found, first = np.unique(part, return_index=True)
    return found.astype(np.int64), np.concatenate([first, [len(grams)]])


def count_ngrams(chunks: DataFrame, parts: int) -> DataFrame:
    """chunk, part, grams, n, n_large: a block for each part that holds words or word pairs of a chunk. grams are sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            chunk, texts = batch.column("chunk").to_numpy(), batch.column("text").to_pylist()
            for c in np.unique(chunk):
                words, pairs, _ = _grams([t for t, own in zip(texts, chunk == c, strict=True) if own])
                held.setdefault(int(c), []).append(_counted(words, pairs))
        for c in list(held):
            counted = held.pop(c)
            grams, place = np.unique(np.concatenate([g for g, _ in counted]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in counted]), len(grams)).astype(np.int64)
            part, edges = _spans(grams, parts)
            for at in range(0, len(part), BLOCKS_PER_BATCH):
                own, cut = part[at : at + BLOCKS_PER_BATCH], edges[at : at + BLOCKS_PER_BATCH + 1]
                inside, cut = slice(cut[0], cut[-1]), cut - cut[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), c, np.int32)), pa.array(own), _lists(grams[inside].view(np.int64), cut),
                                                  *_narrow(n[inside], cut)], ["chunk", "part", "grams", "n", "n_large"])

    # all columns of chunks: with fewer, the texts would be shuffled once more for the scores
    return chunks.mapInArrow(run, "chunk int, part long, grams array<long>, n binary, n_large array<long>")


def total_counts(counts: DataFrame) -> DataFrame:
    """chunk, part, total, total_large: for each block of count_ngrams how often its n-grams stand in all chunks, in the block's order."""
    def run(blocks: pa.Table) -> pa.Table:
        listed = blocks.column("grams")
        edges = np.concatenate([[0], np.cumsum(pc.list_value_length(listed).to_numpy())])
        distinct, place = np.unique(pc.list_flatten(listed).to_numpy(), return_inverse=True)
        n = _wide(blocks.column("n"), blocks.column("n_large"))
        total = np.bincount(place, n, len(distinct)).astype(np.int64)[place]
        return pa.table([blocks.column("chunk"), blocks.column("part"), *_narrow(total, edges)], names=["chunk", "part", "total", "total_large"])

    return counts.groupBy("part").applyInArrow(run, "chunk int, part long, total binary, total_large array<long>")


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", backoff: float = 0.4, least: int = 2,
                    chunk_chars: int = CHUNK_CHARS, part_grams: int = PART_GRAMS) -> DataFrame:
    """key, n_words, log_score, mean_log_score (null without words), n_backoff: one row for each row of docs."""
    value = text_of(text)
    rows = docs.select(F.col(key).alias("key"), value.alias("text"))
    word_count = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")).cast("long")
    size = rows.agg(F.sum(F.length("text")).alias("chars"), F.sum(word_count).alias("words")).first()
    n_words = size["words"] or 0
    chunks, parts = max(1, -(-(size["chars"] or 0) // chunk_chars)), max(1, -(-2 * n_words // part_grams))
    chunk = F.pmod(F.xxhash64(F.col("key").cast("string"), "text"), F.lit(chunks)).cast("int")
    dealt = rows.withColumn("chunk", chunk).repartition(chunks, "chunk")
    back = total_counts(count_ngrams(dealt, parts).repartition(parts, "part"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        words, pairs, lengths = _grams(left.column("text").to_pylist())
        grams, _ = _counted(words, pairs)
        right = right.sort_by("part")
        total = _wide(right.column("total"), right.column("total_large"))
        assert len(total) == len(grams)
        of = lambda h: total[np.minimum(np.searchsorted(grams, h), max(0, len(grams) - 1))] if len(grams) else np.zeros(0)
        own = of(words).astype(float)
        pair = np.where(pairs != 0, of(pairs), 0).astype(float)
        before = np.concatenate([own[:1], own[:-1]])
        backed = (pairs != 0) & (pair < least)
        first = pairs == 0
        with np.errstate(divide="ignore"):
            logs = np.where(first, np.log(own / max(1, n_words)), np.where(backed, np.log(backoff * own / max(1, n_words)), np.log(pair / before)))
        edges = np.concatenate([[0], np.cumsum(lengths)])
        text_no = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.bincount(text_no, logs, len(lengths)) if len(logs) else np.zeros(len(lengths))
        n_back = np.bincount(text_no, backed, len(lengths)).astype(np.int64) if len(logs) else np.zeros(len(lengths), np.int64)
        assert edges[-1] == len(words)
        means = pa.array(np.where(lengths > 0, sums / np.maximum(1, lengths), np.nan), from_pandas=True)
        return pa.table([left.column("key").combine_chunks() if left.num_rows else left.column("key"), pa.array(lengths.astype(np.int64)),
                         pa.array(sums), means, pa.array(n_back)], names=["key", "n_words", "log_score", "mean_log_score", "n_backoff"])

    schema = rows.select("key").schema.add("n_words", "long").add("log_score", "double").add("mean_log_score", "double").add("n_backoff", "long")
    met = dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)
    return met.withColumnRenamed("key", key)
