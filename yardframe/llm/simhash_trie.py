"""SimHash near-duplicates by a binary trie self-join, with connected components.

1. A text's fingerprint has a bit set where more than half of its shingles' XXH64 values have it.
   Equal fingerprints are one entry from here on.
2. The distinct fingerprints are a binary trie. Pairs of its nodes are traversed together from the root: children are paired,
   their differing bits are added up, and a pair beyond the error budget is pruned. Two fingerprints with at most
   `distance` differing bits have at most distance // 2 of them in one of their halves, so the trie is
   traversed twice, once with the halves exchanged, and the upper half's levels are held to that smaller budget.
3. The upper levels are Spark joins, `STEP` levels a round, of node pairs with the counts of their children. A pair whose two
   nodes hold at most `LEAF` fingerprints is closed; however the fingerprints crowd, no task gets more.
4. Closed pairs are traversed to the last bit by one task each, over sorted arrays. The pairs found are
   reported as such (`close_pairs`), or as links to the least fingerprint they connect (`components_of_fingerprints`).

A null text or one without words has fingerprint zero and is linked like any other. Rows are not merged: repeated ids and
texts give repeated rows. A null key names a component only where it has no other key. An empty table
gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardframe.llm.components import components, with_value_of_key
from yardframe.llm.tables import stored

BITS = 64
STEP = 4
LEAF = 4096
SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are unpacked at once
_PAIRS = 1 << 18  # node pairs of a task that are expanded at once


def fingerprint_of(text: str | None, size: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, [\x20\x09-\x0D] only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    span = min(size, len(words))
    starts, ends = starts[: len(words) - span + 1], ends[span - 1 :]
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(starts), _BLOCK):
        part = zip(starts[a : a + _BLOCK].tolist(), ends[a : a + _BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """key, fingerprint (64 bits as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_of(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.int64())], ["key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint long")


# ---------------------------------------------------------------- one pair of subtrees


def _allowed(depth: np.ndarray | int, distance: int) -> np.ndarray | int:
    """Differing bits a pair may have after `depth` levels."""
    return np.where(np.asarray(depth) <= BITS // 2, distance // 2, distance)


def traverse(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the sorted, distinct fingerprints of two nodes at `depth` that stay within the budget.

    b is None for a node with itself, which gives each pair once. Nodes are ranges of the sorted arrays; all pairs of
    one level are expanded together, a bounded number at a time.
    """
    own = b is None
    b = a if own else b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    whole = (np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)]), np.array([errors]))
    waiting = [(depth, whole)] if len(a) and len(b) else []
    while waiting:
        level, pairs = waiting.pop()
        if len(pairs[0]) > _PAIRS:
            waiting.extend((level, tuple(c[i : i + _PAIRS] for c in pairs)) for i in range(0, len(pairs[0]), _PAIRS))
            continue
        a_low, a_high, b_low, b_high, spent = pairs
        single = (a_high - a_low == 1) & (b_high - b_low == 1)
        if single.any():
            i, j = a_low[single], b_low[single]
            apart = np.bitwise_count(a[i] ^ b[j])
            # the upper half is held to its own budget; pairs it prunes are met in the other trie
            upper = np.bitwise_count((a[i] ^ b[j]) >> np.uint64(BITS // 2))
            good = (apart <= distance) & (upper <= distance // 2)
            good &= i < j if own else True
            found.append((a[i[good]], b[j[good]]))
            rest = ~single
            a_low, a_high, b_low, b_high, spent = (c[rest] for c in pairs)
        if not len(a_low) or level == BITS:
            continue
        bit = np.uint64(BITS - 1 - level)
        ones_a = np.concatenate([[0], np.cumsum((a >> bit) & np.uint64(1), dtype=np.int64)])
        ones_b = ones_a if own else np.concatenate([[0], np.cumsum((b >> bit) & np.uint64(1), dtype=np.int64)])
        a_cut = a_high - (ones_a[a_high] - ones_a[a_low])
        b_cut = b_high - (ones_b[b_high] - ones_b[b_low])
        itself = (a_low == b_low) & own
        children = []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            al, ah = (a_cut, a_high) if x else (a_low, a_cut)
            bl, bh = (b_cut, b_high) if y else (b_low, b_cut)
            cost = spent + (x != y)
            keep = (al < ah) & (bl < bh) & (cost <= _allowed(level + 1, distance))
            keep &= ~((ah - al == 1) & (bh - bl == 1) & (al == bl) & own)
            if (x, y) == (1, 0):
                keep &= ~itself
            children.append(tuple(c[keep] for c in (al, ah, bl, bh, cost)))
        following = tuple(np.concatenate(c) for c in zip(*children, strict=True))
        if len(following[0]):
            waiting.append((level + 1, following))
    if not found:
        return a[:0], a[:0]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _least_reached(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, least fingerprint it is connected with) for all ends of the pairs."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        following = label.copy()
        np.minimum.at(following, i, low)
        np.minimum.at(following, j, low)
        np.minimum.at(following, label[i], low)
        np.minimum.at(following, label[j], low)
        following = following[following]
        if (following == label).all():
            return ids, ids[label]
        label = following


# ---------------------------------------------------------------- the trie's upper levels


def _node(depth: int, turned: str | Column = "turned") -> Column:
    """Number of the node at `depth` above a fingerprint."""
    return F.shiftrightunsigned(F.col(turned) if isinstance(turned, str) else turned, BITS - depth) if depth else F.lit(0).cast("long")


def _closed_pairs(turned: DataFrame, distance: int, leaf: int) -> list[tuple[int, DataFrame]]:
    """(depth, node pairs a, b, errors) whose subtrees together hold at most `leaf` fingerprints."""
    total = turned.groupBy("half").agg(F.count("*").alias("n_a"))
    open_pairs = total.select("half", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("errors"),
                              "n_a", F.col("n_a").alias("n_b"))
    depth, closed = 0, []
    while True:
        alone = F.col("a") == F.col("b")
        small = F.when(alone, F.col("n_a")).otherwise(F.col("n_a") + F.col("n_b")) <= leaf
        open_pairs = stored(open_pairs)
        done = open_pairs.where(small if depth < BITS else F.lit(True))
        if not done.isEmpty():
            closed.append((depth, done.select("half", "a", "b", "errors")))
        open_pairs = open_pairs.where(~small)
        if depth == BITS or open_pairs.isEmpty():
            return closed
        inside = open_pairs.select("half", F.explode(F.array("a", "b")).alias("node")).distinct()
        children = (turned.withColumn("node", _node(depth)).join(inside, ["half", "node"], "left_semi")
                    .groupBy("half", "node", _node(depth + STEP).alias("child")).agg(F.count("*").alias("n")))
        children = stored(children)
        left = children.select("half", F.col("node").alias("a"), F.col("child").alias("child_a"), F.col("n").alias("m_a"))
        right = children.select("half", F.col("node").alias("b"), F.col("child").alias("child_b"), F.col("n").alias("m_b"))
        depth += STEP
        allowed = int(_allowed(depth, distance))
        new_bits = F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND((1 << STEP) - 1)
        spent = F.col("errors") + F.bit_count(new_bits)
        first = open_pairs.drop("n_a", "n_b").join(left, ["half", "a"])
        both = first.join(right, (first["half"] == right["half"]) & (first["b"] == right["b"]) & (spent <= allowed)
                          & ((first["a"] != first["b"]) | (F.col("child_a") <= F.col("child_b"))))
        open_pairs = both.select(first["half"], F.col("child_a").alias("a"), F.col("child_b").alias("b"), spent.alias("errors"),
                                 F.col("m_a").alias("n_a"), F.col("m_b").alias("n_b"))


def _joined(distinct: DataFrame, distance: int, leaf: int, forest: bool) -> DataFrame:
    """x, y: pairs of fingerprints found in the closed node pairs (forest: with the least they are connected with)."""
    halves = F.explode(F.array(
        F.struct(F.lit(0).alias("half"), F.col("fingerprint").alias("turned")),
        F.struct(F.lit(1).alias("half"), F.shiftleft("fingerprint", 32).bitwiseOR(F.shiftrightunsigned("fingerprint", 32)).alias("turned"))))
    turned = stored(distinct.select(halves.alias("h")).select("h.half", "h.turned"))
    parts = []
    for depth, pairs in _closed_pairs(turned, distance, leaf):
        named = pairs.withColumn("pair", F.concat_ws(":", F.lit(depth), "half", F.hex("a"), F.hex("b")))
        sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")))).otherwise(
            F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side"))))
        members = named.select("half", "pair", "errors", F.explode(sides).alias("s")).select("half", "pair", "errors", "s.node", "s.side")
        parts.append(turned.withColumn("node", _node(depth)).join(members, ["half", "node"])
                     .select("pair", F.lit(depth).alias("depth"), "half", "errors", "side", "turned"))
    if not parts:
        return distinct.select(F.col("fingerprint").alias("x"), F.col("fingerprint").alias("y")).where(F.lit(False))
    tasks = parts[0]
    for part in parts[1:]:
        tasks = tasks.unionByName(part)

    def run(rows: pa.Table) -> pa.Table:
        value = rows.column("turned").to_numpy().view(np.uint64)
        side = rows.column("side").to_numpy()
        a, b = np.sort(value[side == 0]), np.sort(value[side == 1])
        x, y = traverse(a, b if len(b) else None, rows.column("depth")[0].as_py(), rows.column("errors")[0].as_py(), distance)
        if forest:
            x, y = _least_reached(x, y)
            x, y = x[x != y], y[x != y]
        if rows.column("half")[0].as_py():
            x, y = ((v << np.uint64(32)) | (v >> np.uint64(32)) for v in (x, y))
        return pa.table({"x": pa.array(x.view(np.int64)), "y": pa.array(y.view(np.int64))})

    return tasks.groupBy("pair").applyInArrow(run, "x long, y long")


def close_pairs(distinct: DataFrame, distance: int = 2, leaf: int = LEAF) -> DataFrame:
    """x < y (as signed numbers), differing bits of all pairs of distinct fingerprints at most `distance` apart."""
    pairs = _joined(distinct, distance, leaf, forest=False)
    pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    return pairs.withColumn("bits", F.bit_count(F.col("x").bitwiseXOR(F.col("y"))))


def components_of_fingerprints(distinct: DataFrame, distance: int = 2, leaf: int = LEAF) -> DataFrame:
    """node (fingerprint), component (one fingerprint of those that links reach), for linked fingerprints."""
    return components(_joined(distinct, distance, leaf, forest=True).select(F.col("x").alias("a"), F.col("y").alias("b")))


def simhash_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 3, distance: int = 2,
                   leaf: int = LEAF) -> DataFrame:
    """For each row: key, fingerprint (16 hex digits), component_id (the least key that links reach, its own included)."""
    rows = stored(fingerprints(docs, key=key, text=text, size=size))
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("key").alias("least_key"), F.count("*").alias("n")))
    labels = components_of_fingerprints(distinct.select("fingerprint"), distance, leaf)
    named = distinct.join(labels, distinct["fingerprint"] == labels["node"], "left").select(
        "fingerprint", "least_key", "n", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("least_key").alias("component_id"))
    named = stored(named.join(least, "component").select("fingerprint", "n", "component_id"))
    out = with_value_of_key(rows, named, "fingerprint")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
