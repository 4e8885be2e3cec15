"""Mixing sources to target weights with DataFrame functions only.

1. Targets. The words of all sources are shared by weight; a source's target stops at `most` times its words
   and the excess is shared again by weight. With sources in the order of their cap per weight, the common level is
   read from running totals: it is the first at which a source stays below its cap.
2. Blocks. Documents of a source fall into blocks by a hash of the row, about BLOCK_ROWS rows each. A source's
   target gives whole passes over its blocks, then blocks in a permuted order, then documents of one
   boundary block, each taken that still fits. So a source misses its target by less than its smallest
   document not taken, and no document is taken more than `most` times.
3. Splitting tree. The exact numbers of block draws by source are divided among output shards: each node halves its
   draws, and how many of each source go left is a draw from the multivariate hypergeometric law, one source
   after the other, by inversion. Leaves are shards.
4. Shard s takes the next so many draws of each source's permuted draws, so shards are disjoint, and rows
   are shuffled inside their shard.

All randomness comes from hashes of a seed, so reruns agree. Block tables and running totals are distributed; the
splitting tree holds one number for each source and node, so it grows with the number of sources, not with
rows. A null or empty text has size 0 and costs nothing; null is a source of its own and the last; rows alike in id
and text are taken together; an empty table gives an empty mix. Further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yardframe.llm.tables import running_totals, stored, text_of

WORD = r"[^\x20\x09-\x0D]++"
BLOCK_ROWS = 256
SHARDS = 16
MOST = 3


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, *, most: int = MOST, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sizes: source, source_size, rows. Adds rank (by code point, null last), weight and target."""
    ranked = running_totals(sizes.withColumn("one", F.lit(1)), ["source"], ["one", "source_size"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    caps = ranked.select("source", "source_size", "rows", F.col("before_one").alias("rank"), F.col("before_source_size").alias("before_source"),
                         weight.cast("double").alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    caps = stored(caps.withColumn("per_weight", F.col("cap") / F.col("weight")))
    total = caps.agg(F.sum("source_size").cast("double").alias("words"), F.sum("weight").alias("weight")).first()
    if total["words"] is None:
        return caps.withColumn("target", F.lit(0.0))
    steps = running_totals(caps, ["per_weight", "rank"], ["cap", "weight"])
    level = (F.lit(total["words"]) - F.col("before_cap")) / (F.lit(total["weight"]) - F.col("before_weight"))
    steps = steps.withColumn("level", level).where(F.col("level") <= F.col("per_weight"))
    found = steps.agg(F.min_by("level", F.struct("per_weight", "rank")).alias("level")).first()
    level = F.lit(float("inf") if found["level"] is None else found["level"])  # none: rounding at the last cap
    return caps.withColumn("target", F.least(F.col("cap"), level * F.col("weight")))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value written into the expression once, however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(marked: Column, others: Column, drawn: Column, uniform: Column) -> Column:
    """How many of `marked` are among `drawn` of marked + others, by inversion around the mode.

    Weights follow from each other by the ratio of neighbouring probabilities. Twelve standard
    deviations and twelve more values on each side leave out less than doubles can show. Values that are used again are
    bound: written out, the expression of one draw would take the driver more memory to plan than the rest of the mix.
    """
    def pick(v: Column, r: Column) -> Column:
        ratio = lambda k: (v["k_all"] - k) * (v["n"] - k) / ((k + 1.0) * (v["n_rest"] - v["n"] + k + 1.0))
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        total = F.aggregate(F.sequence(r["first"], r["last"]), start,
                            lambda a, k: F.struct((a["weight"] * ratio(k)).alias("weight"), (a["sum"] + a["weight"]).alias("sum")), lambda a: a["sum"])
        begin = F.struct(F.lit(1.0).alias("weight"), (v["uniform"] * total).alias("left"), F.lit(None).cast("long").alias("pick"))
        step = lambda a, k: F.struct(
            (a["weight"] * ratio(k)).alias("weight"), (a["left"] - a["weight"]).alias("left"),
            F.when(a["pick"].isNull() & (a["left"] <= a["weight"]), k).otherwise(a["pick"]).alias("pick"))
        return F.aggregate(F.sequence(r["first"], r["last"]), begin, step, lambda a: F.coalesce(a["pick"], r["last"]))

    def shape(v: Column) -> Column:
        both = v["k_all"] + v["n_rest"]
        spread = F.sqrt(F.greatest(F.lit(0.0), v["n"] * (v["k_all"] / both) * (v["n_rest"] / both) * (both - v["n"]) / F.greatest(F.lit(1.0), both - 1)))
        return F.struct(F.greatest(F.lit(0.0), v["n"] - v["n_rest"]).cast("long").alias("low"), F.least(v["n"], v["k_all"]).cast("long").alias("high"),
                        F.floor((v["n"] + 1) * (v["k_all"] + 1) / (both + 2)).alias("mode"), (F.ceil(12 * spread) + 12).alias("width"))

    def span(s: Column) -> Column:
        return F.struct(F.greatest(s["low"], F.least(s["mode"], s["high"]) - s["width"]).alias("first"),
                        F.least(s["high"], F.greatest(s["mode"], s["low"]) + s["width"]).alias("last"))

    values = F.struct(marked.cast("double").alias("k_all"), others.cast("double").alias("n_rest"), drawn.cast("double").alias("n"), uniform.alias("uniform"))
    picked = bound(values, lambda v: bound(bound(shape(v), span), lambda r: pick(v, r)))
    return F.when((drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).when(others <= 0, drawn).otherwise(picked)


def _halves(n: Column, level: Column, seed: int) -> Column:
    """The two children of a node of the tree: half of its draws goes left, the rest goes right."""
    def draw(a: Column, p: Column) -> Column:
        """One source's share of the draws that go left, given what earlier sources of the node took."""
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), level, n["node"], p["rank"]), 11)
        taken = hypergeometric(p["quota"], a["rest"] - p["quota"], a["left"], bits.cast("double") / float(1 << 53))
        return bound(taken, lambda t: F.struct((a["left"] - t).alias("left"), (a["rest"] - p["quota"]).alias("rest"),
                                               F.concat(a["parts"], F.array(F.struct(p["rank"].alias("rank"), t.alias("quota")))).alias("parts")))

    def children(to_left: Column) -> Column:
        right = F.zip_with(n["parts"], to_left, lambda p, q: F.struct(p["rank"].alias("rank"), (p["quota"] - q["quota"]).alias("quota")))
        return F.array(F.struct((n["node"] * 2).alias("node"), to_left.alias("parts")), F.struct((n["node"] * 2 + 1).alias("node"), right.alias("parts")))

    def deal(total: Column) -> Column:
        begin = F.struct(F.floor(total / 2).cast("long").alias("left"), total.alias("rest"), F.array().cast("array<struct<rank:bigint,quota:bigint>>").alias("parts"))
        return bound(F.aggregate(n["parts"], begin, draw, lambda a: a["parts"]), children)

    return bound(F.aggregate(n["parts"], F.lit(0).cast("long"), lambda a, p: a + p["quota"]), deal)


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: rank, quota. Returns rank, shard, first: where the shard's run of the source's draws begins."""
    parts = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("parts"))
    root = F.array(F.struct(F.lit(0).cast("long").alias("node"), F.col("parts").alias("parts")))
    # One expression walks down all levels: planned level by level, it took the driver several times the memory.
    tree = F.aggregate(F.array(*map(F.lit, range(levels))).cast("array<int>"), root,
                       lambda nodes, level: F.flatten(F.transform(nodes, lambda n: _halves(n, level, seed))))
    leaves = parts.select(F.explode(tree).alias("leaf")).select(F.col("leaf.node").alias("shard"), F.explode("leaf.parts").alias("part"))
    leaves = stored(leaves.select("shard", "part.rank", "part.quota"))
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.select("rank", "shard", F.coalesce(F.sum("quota").over(ahead), F.lit(0)).alias("first"))


def plan_mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST, levels: int = 4,
             seed: int = 20240229) -> tuple[DataFrame, DataFrame]:
    """The row table (key, source, size, block, row_hash) and the block table (source, block, source_size, target,
    shards of its draws, boundary: hashes of the rows taken once more, boundary_shard)."""
    row_hash = F.xxhash64(F.lit(seed), F.col(key).cast("string"), text_of(text))
    rows = stored(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(text).alias("size"), row_hash.alias("row_hash")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = stored(source_targets(sizes, most=most))
    largest = sources.agg(F.max("rows")).first()[0] or 0
    blocks = max(1, -(-largest // BLOCK_ROWS))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "row_hash"), F.lit(blocks)))
    cells = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    cells = cells.withColumn("turn", F.xxhash64(F.lit(seed + 2), "source", "block"))
    cells = running_totals(cells, ["source", "turn", "block"], ["words"])
    on = cells["source"].eqNullSafe(sources["source"])
    cells = cells.join(sources, on).select(cells["source"], "rank", "block", "words", "turn", "source_size", "target",
                                           (F.col("before_words") - F.col("before_source")).alias("before"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    cells = cells.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    full = (F.col("before") + F.col("words") <= F.col("rest")) & (F.col("passes") < most)
    cells = cells.withColumn("copies", F.col("passes") + full.cast("int"))
    edge = ~full & (F.col("before") < F.col("rest")) & (F.col("passes") < most)
    cells = stored(cells.withColumn("edge", edge))

    # The boundary block of each source: rows in a permuted order, each taken that still fits.
    edges = cells.where("edge").select(F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("gap"))
    items = rows.join(edges, rows["source"].eqNullSafe(F.col("s")) & (rows["block"] == F.col("b")))
    items = items.groupBy("s", "b", "gap", "row_hash").agg(F.sum("size").cast("double").alias("size"))
    items = items.groupBy("s", "b", "gap").agg(F.sort_array(F.collect_list(F.struct("row_hash", "size"))).alias("items"))
    begin = F.struct(F.col("gap").alias("gap"), F.array().cast("array<bigint>").alias("picked"))
    fit = F.aggregate("items", begin, lambda a, i: F.when(i["size"] <= a["gap"], F.struct(
        (a["gap"] - i["size"]).alias("gap"), F.concat(a["picked"], F.array(i["row_hash"])).alias("picked"))).otherwise(a), lambda a: a["picked"])
    fit = items.select("s", "b", fit.alias("boundary"))

    draws = cells.select("source", "rank", "block", F.explode(F.expr("sequence(0, copies + int(edge))")).alias("draw"), "copies", "edge")
    draws = draws.where(F.col("draw") < F.col("copies") + F.col("edge").cast("int"))
    draws = draws.withColumn("turn", F.xxhash64(F.lit(seed + 3), "source", "block", "draw")).withColumn("one", F.lit(1).cast("long"))
    draws = running_totals(draws, ["rank", "turn", "block"], ["one"])
    quotas = draws.groupBy("rank").agg(F.count("*").alias("quota"), F.min("before_one").alias("base"))
    quotas = stored(quotas)
    leaves = split_quotas(quotas.select("rank", "quota"), levels, seed)
    leaves = leaves.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "first"))), lambda x: x["first"]).alias("starts"))
    leaves = leaves.join(quotas, "rank")
    position = F.col("before_one") - F.col("base")
    draws = draws.join(leaves, "rank").withColumn("position", position)
    shard = (F.size(F.filter("starts", lambda x: x <= F.col("position"))) - 1).cast("int")
    draws = draws.select("source", "block", "draw", F.when(F.col("draw") < F.col("copies"), shard).alias("shard"),
                         F.when(F.col("draw") >= F.col("copies"), shard).alias("edge_shard"))
    shards = draws.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.sort_array(F.collect_list("shard")).alias("shards"), F.max("edge_shard").alias("boundary_shard"))
    same = cells["source"].eqNullSafe(F.col("s")) & (cells["block"] == F.col("b"))
    table = cells.join(shards, same, "left").drop("s", "b")
    table = table.join(fit, table["source"].eqNullSafe(F.col("s")) & (table["block"] == F.col("b")), "left")
    none = F.array().cast("array<int>")
    # Stored: a row for each block, whose plan is not planned again with that of the rows.
    return rows, stored(table.select(
        table["source"], table["block"], "source_size", "target", F.coalesce("shards", none).alias("shards"),
        F.coalesce("boundary", F.array().cast("array<bigint>")).alias("boundary"), "boundary_shard"))


def with_draws(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with source, block, row_hash) joined to their block: source_size, target, draws (one shard for each copy)."""
    t = table.withColumnsRenamed({"source": "t_source", "block": "t_block"})
    joined = rows.join(t, rows["source"].eqNullSafe(F.col("t_source")) & (rows["block"] == F.col("t_block")))
    more = F.when(F.array_contains("boundary", F.col("row_hash")), F.concat("shards", F.array("boundary_shard"))).otherwise(F.col("shards"))
    return joined.select(*[rows[c] for c in rows.columns], "source_size", "target", more.alias("draws"))


def mix_counts(docs: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """For each row of docs: key, source, size, source_size, target, taken (words that the mix takes), draws (shard of each copy)."""
    rows, table = plan_mix(docs, key=key, **options)
    out = with_draws(rows, table)
    return out.select(F.col("key").alias(key), "source", "size", "source_size", "target",
                      (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mixed_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 20240229, **options) -> DataFrame:
    """The mix itself: rows of docs, repeated as drawn, dealt by shard and shuffled inside it. Columns as in docs."""
    rows, table = plan_mix(docs, key=key, text=text, source=source, seed=seed, **options)
    picked = with_draws(rows.select("source", "block", "row_hash").distinct(), table)
    picked = picked.select(F.col("source").alias("mix_source"), F.col("row_hash").alias("mix_hash"), F.explode("draws").alias("mix_shard"))
    picked = picked.withColumn("mix_turn", F.xxhash64(F.lit(seed + 4), "mix_hash", "mix_shard"))
    row_hash = F.xxhash64(F.lit(seed), F.col(key).cast("string"), text_of(text))
    inner = docs.select(F.struct(*docs.columns).alias("mix_row"), row_hash.alias("mix_hash"), F.col(source).alias("row_source"))
    joined = inner.join(picked, "mix_hash").where(F.col("row_source").eqNullSafe(F.col("mix_source")))
    dealt = joined.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_turn")
    return dealt.select("mix_row.*")
