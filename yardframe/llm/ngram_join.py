"""N-gram Jaccard join by vertical partitioning, with connected components.

1. Every text becomes the set of its distinct word shingles (64-bit hashes); equal sets (by 128 bits) are one node.
2. Shingles have one global order: by count where they are frequent, then by hash. Two sets of Jaccard t share `SHARED`
   of their first n - ceil(t * n) + SHARED shingles in any such order, so nodes with that many in common are candidates.
   Counts cover all texts; they only order, so a count that stays below the true one costs time, not links.
3. A prefix shingle that no other prefix holds is in no set with which a later prefix shingle is shared. So for each
   shared shingle the lone ones before it bound the overlap of any two nodes that share it, before a pair is made.
4. Each node is first paired with one pivot only: of the pivots of its shingles, which have fewest lone shingles, the one
   it shares most with. Shingles whose nodes are one component by then are done.
5. The order of shingle hashes is cut into fragments. For a pair the overlap of each fragment is counted by itself, and
   the counts are summed per pair; pairs that reach the threshold are links. A pivot of many pairs is salted.
6. Two nodes with the same pivot differ from it by few shingles, `missing` and `added` ones, which the fragments give too. Their
   overlap is the pivot's size less what either misses, plus what both miss or both add. So they can only be linked if
   they share such a shingle, or if both are linked to the pivot: joining on those, not on the shingles that the
   whole group has, gives their exact overlap. Nodes of different pivots that are still apart are paired by shingle.
   A pair is left out only where a chain of confirmed links joins the two already, so components are exact.

A null text or one without words has an empty set and is linked with nothing; fewer words than a shingle are one
shingle. Repeated rows are copies. A row with a null key takes part but names no component, unless all keys of a
component are null. An empty table gives no rows. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardframe.llm.components import components, with_value_of_key
from yardframe.llm.tables import stored, text_of, trimmed
from yardframe.llm.words import SPACED_LOWER, gram_hashes, mix, pieces, split_words

FREQUENT = 1 << 20  # shingles whose counts are known to all tasks: 16 MB
SEEN_FROM = 2  # times among COUNTED_AT_ONCE shingles
COUNTED_AT_ONCE = 1 << 20  # 8 MB of shingles of whole texts
SHARED = 3
FRAGMENTS = 8
BROADCAST_TEXTS = 1 << 20  # text numbers: 16 MB; beyond, texts are joined by shuffle
PAIRS_OF_A_PIVOT = 512  # more pairs of one pivot are split


def shingle_sets(texts: list[str], size: int) -> Iterator[np.ndarray]:
    for a, b in pieces(texts):
        w = split_words(texts[a:b], SPACED_LOWER)
        for first, end in zip(w.first[:-1], w.first[1:], strict=True):
            yield np.unique(gram_hashes(w.hash[first:end], min(size, max(1, end - first)))) if end > first else np.zeros(0, np.uint64)


def set_number(s: np.ndarray) -> bytes:
    """16 bytes for a set of shingles."""
    halves = [np.add.reduce(mix(s ^ np.uint64(seed)), dtype=np.uint64) + np.uint64(len(s))
              for seed in (0x5851F42D4C957F2D, 0xA0761D6478BD642F)]
    return mix(np.array(halves, np.uint64)).tobytes()


def frequent_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, FREQUENT at most, sorted, and their counts. A count is taken whole or not at all."""
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
        some = n >= SEEN_FROM
        return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some].astype(np.int64))], ["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                held.append(s)
                total += len(s)
                if total > COUNTED_AT_ONCE:
                    yield counted(held)
                    held, total = [], 0
        yield counted(held)

    counts = stored(texts.select("text").mapInArrow(trimmed(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2"))
    least = _least_count(counts)
    rows = counts.where(F.col("n") >= least).toArrow()
    h, n = rows.column("shingle").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _least_count(counts: DataFrame) -> int:
    """The least n such that at most FREQUENT rows have n or more, found by halving the range of counts."""
    top = counts.agg(F.max("n")).first()[0] or 0
    low, high, above = 0, int(top) + 1, 0  # at most FREQUENT rows have n >= high; `above` of them
    while low + 1 < high:
        width = max(1, (high - low) // 256)
        inside = counts.where((F.col("n") > low) & (F.col("n") < high))
        bins = {r["bin"]: r["count"] for r in inside.groupBy(F.floor((F.col("n") - low - 1) / width).alias("bin")).count().collect()}
        fits, cut, over = above, high, False
        for i in sorted(bins, reverse=True):
            if fits + bins[i] > FREQUENT:
                low, over = max(low, low + i * width), True
                break
            fits += bins[i]
            cut = low + 1 + i * width
        if not over:
            return low + 1
        above, high = fits, min(cut, low + width + 1)
        if width == 1:
            return high
    return high


def prefixes(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """key, mark (of the text), node, n (set size), prefix: the set's first shingles in the global order."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent_shingles(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            node, n, first = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), size):
                at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                rank = np.where(common[at] == s, counts[at], 0) if len(common) else np.zeros(len(s), np.int64)
                must = (percent * len(s) + 99) // 100
                keep = len(s) - must + min(SHARED, must)
                first.append(s[np.lexsort((s, rank))[:keep]].view(np.int64))
                node.append(set_number(s))
                n.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("mark"), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64()))],
                ["key", "mark", "set", "n", "prefix"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.select("key", "mark", "text").mapInArrow(trimmed(run), f"key {kind}, mark long, set binary, n long, prefix array<long>")


def fragments_of(texts: DataFrame, size: int) -> DataFrame:
    """texts: text, set, node, rows (with that text). node, rows, fragment, shingles: the set cut by ranges of the
    hash order, empty ones too. A text that has copies comes once a task."""
    bounds = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = []
            for i, (node, rows) in enumerate(zip(batch.column("node").to_pylist(), batch.column("rows").to_pylist(), strict=True)):
                if node not in seen:
                    fresh.append(i)
                if rows > 1:
                    seen.add(node)
            batch = batch.take(pa.array(fresh, pa.int64()))
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("node", "rows", "set", "text")]
            for node, rows, wanted, s in zip(*columns[:3], shingle_sets(columns[3], size), strict=True):
                if set_number(s) == wanted:
                    cut = np.split(s.view(np.int64), np.searchsorted(s, bounds))
                    out.extend((node, rows, i, x) for i, x in enumerate(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32()),
                 pa.array([x[3] for x in out], pa.list_(pa.int64()))], ["node", "rows", "fragment", "shingles"])

    return texts.select("text", "set", "node", "rows").mapInArrow(trimmed(run), "node long, rows long, fragment int, shingles array<long>")


def compared(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """a, b, fragment, added (shingles of a that b has not), missing (of b that a has not), size (of a) for the pairs
    (a, b). b may be in very many pairs."""
    crowd = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_OF_A_PIVOT).alias("salts"))
    crowd = stored(crowd.where("salts > 1"))
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("a"), "salts")).cast("int")
    salted = pairs.join(crowd, "b", "left").select("a", "b", salt.alias("salt"))
    left = fragments.select(F.col("node").alias("a"), "fragment", F.col("shingles").alias("s"))
    copies = F.sequence(F.lit(0), (F.coalesce("salts", F.lit(1)) - 1).cast("int"))
    right = fragments.select(F.col("node").alias("b"), "fragment", F.col("shingles").alias("t"))
    right = right.join(pairs.select("b").distinct(), "b", "left_semi").join(crowd, "b", "left").withColumn("salt", F.explode(copies)).drop("salts")
    partial = salted.join(left, "a").join(right, ["b", "salt", "fragment"])
    return partial.select("a", "b", "fragment", F.array_except("s", "t").alias("added"), F.array_except("t", "s").alias("missing"),
                          F.size("s").cast("long").alias("size"))


def measured(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs with overlap, the sum of the fragments' overlaps."""
    partial = parts.select("a", "b", (F.col("size") - F.size("added")).alias("overlap"))
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")), ["a", "b"])


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(_reaches(F.col("overlap"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _around_pivots(stars: DataFrame, parts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one pivot that are not one component yet.

    stars: a, b (pivot), n_a, n_b, overlap. parts: their fragments' added and missing shingles.
    """
    shown = stars.select("a", "b", F.col("n_a").alias("n"), F.col("n_b").alias("n_pivot"), (F.col("n_b") - F.col("overlap")).alias("lost"))
    shown = shown.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    several = shown.groupBy("b").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("b")
    marks = parts.join(several, "b", "left_semi").select("a", "b", F.explode(F.concat(
        F.transform("added", lambda x: F.struct(F.lit(1).alias("added"), x.alias("shingle"))),
        F.transform("missing", lambda x: F.struct(F.lit(0).alias("added"), x.alias("shingle"))))).alias("d")).select("a", "b", "d.*")
    twice = marks.groupBy("b", "added", "shingle").agg(F.count("*").alias("holders")).where("holders > 1").drop("holders")
    marks = stored(marks.join(twice, ["b", "added", "shingle"]))
    # shared added shingles are at most those that others of the pivot add as well
    extra = marks.groupBy("a", "b").agg(F.count_if(F.col("added") == 1).alias("extra"))
    marks = stored(marks.join(shown.join(extra, ["a", "b"]), ["a", "b"]))
    one = marks.select("b", "added", "shingle", F.col("a").alias("x"), F.col("n").alias("n_x"), F.col("lost").alias("lost_x"), F.col("extra").alias("extra_x"),
                       F.col("component").alias("c_x"), "n_pivot")
    two = marks.select("b", "added", "shingle", F.col("a").alias("y"), F.col("n").alias("n_y"), F.col("lost").alias("lost_y"), F.col("extra").alias("extra_y"),
                       F.col("component").alias("c_y"))
    most = F.col("n_pivot") - F.greatest("lost_x", "lost_y") + F.least("extra_x", "extra_y")
    room = _reaches(F.least(most, F.col("n_x"), F.col("n_y")), F.col("n_x"), F.col("n_y"), percent)
    both = one.join(two, ["b", "added", "shingle"]).where((F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")) & room)
    both = both.groupBy("b", "x", "y", "n_x", "n_y", "lost_x", "lost_y", "n_pivot").agg(F.count("*").alias("common"))
    overlap = F.col("n_pivot") - F.col("lost_x") - F.col("lost_y") + F.col("common")
    return both.where(_reaches(overlap, F.col("n_x"), F.col("n_y"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _reaches(overlap: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _held(nodes: DataFrame, percent: int) -> DataFrame:
    """shingle, node, n, most: the prefix shingles that two nodes hold at least, with the greatest overlap that
    the node can have with any other that holds the shingle in its prefix."""
    firsts = nodes.select("node", "n", F.posexplode("prefix").alias("place", "shingle"))
    twice = firsts.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1").select("shingle")
    held = firsts.join(twice, "shingle")
    before = F.row_number().over(Window.partitionBy("node").orderBy("place")) - 1
    most = F.col("n") - (F.col("place") - before)
    return held.select("shingle", "node", "n", most.alias("most")).where(100 * F.col("most") >= percent * F.col("n"))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether lengths and lone shingles leave room for a link; columns n_<name> and most_<name>."""
    most = F.least(F.col(f"most_{a}"), F.col(f"most_{b}"))
    return _reaches(most, F.col(f"n_{a}"), F.col(f"n_{b}"), percent)


def _must_share(percent: int) -> Column:
    return F.least(F.lit(SHARED), F.ceil(percent * F.least("n_a", "n_b") / 100))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of docs: key, n_shingles, component_id (least key that links reach)."""
    value = text_of(text)
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(value).alias("mark"), value.alias("text"))
    rows = stored(prefixes(texts, size, percent))
    sets = rows.where("n > 0").groupBy("set").agg(F.min("mark").alias("mark"), F.max("n").alias("n"), F.min("key").alias("least_key"),
                                                  F.count("*").alias("rows"), F.first("prefix").alias("prefix"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()))
    held = stored(_held(nodes, percent))
    labels = _labels(texts, nodes, held, size, percent)
    named = nodes.join(labels, "node", "left").select("set", "rows", "least_key", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least_key").alias("component_id"))
    named = stored(named.join(least, "component").select("set", "rows", "component_id"))
    some = with_value_of_key(rows.where("n > 0").select("key", "set", "n"), named, "set", "rows")
    none = rows.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    return some.select("key", "n", "component_id").unionByName(none).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _labels(texts: DataFrame, nodes: DataFrame, held: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component by confirmed links that connect what the threshold connects."""
    def parts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = stored(nodes.select("node", "mark", "set", "rows").join(wanted, "node", "left_semi"))
        few = wanted.count() <= BROADCAST_TEXTS
        found = texts.join(F.broadcast(wanted) if few else wanted, "mark")
        cut = stored(fragments_of(found, size))
        once = cut.where("rows = 1").unionByName(cut.where("rows > 1").dropDuplicates(["node", "fragment"]))
        return stored(compared(pairs, once.drop("rows")))

    # every node with the best of its shingles' pivots
    lead = F.struct((F.col("n") - F.col("most")).alias("lone"), F.xxhash64("node").alias("draw"), F.col("node").alias("b"),
                    F.col("n").alias("n_b"), F.col("most").alias("most_b"))
    pivots = held.groupBy("shingle").agg(F.min(lead).alias("pivot")).select("shingle", "pivot.b", "pivot.n_b", "pivot.most_b")
    star = held.select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a")).join(pivots, "shingle")
    star = star.where((F.col("a") != F.col("b")) & _may_link("a", "b", percent))
    star = star.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= _must_share(percent))
    best = star.groupBy("a").agg(F.max_by(F.struct("b", "n_a", "n_b"), F.struct("shared", F.col("b"))).alias("p"))
    pairs = stored(best.select("a", "p.*"))
    parts = parts_of(pairs)
    stars = stored(measured(pairs, parts))
    links = stored(_linked(stars, percent))
    labels = components(links)
    near = stored(_around_pivots(stars, parts, labels, percent))
    if not near.isEmpty():
        links = stored(links.unionByName(near))
        labels = components(links)

    # nodes of different pivots that are still apart
    placed = held.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = placed.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("pivot")), "node", "left")
    placed = placed.withColumn("pivot", F.coalesce("pivot", "node"))
    mixed = placed.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("pivot").alias("p0"), F.max("pivot").alias("p1"))
    mixed = mixed.where("c0 <> c1 and p0 <> p1").select("shingle")
    apart = stored(placed.join(mixed, "shingle", "left_semi"))
    one = apart.select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("most").alias("most_a"), F.col("component").alias("component_a"), F.col("pivot").alias("pivot_a"))
    two = apart.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("most").alias("most_b"), F.col("component").alias("component_b"), F.col("pivot").alias("pivot_b"))
    rest = one.join(two, "shingle").where((F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b"))
                                          & (F.col("pivot_a") != F.col("pivot_b")) & _may_link("a", "b", percent))
    rest = rest.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    rest = rest.where(F.col("shared") >= _must_share(percent)).drop("shared")
    rest = stored(rest.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    return labels if rest.isEmpty() else components(stored(links.unionByName(_linked(measured(rest, parts_of(rest)), percent))))
