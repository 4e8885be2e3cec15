"""Joins, first rows, ranks, sorts, pivots and exact cut points."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from yardframe.operators.cutpoints import at_most, hash_cutoffs, order_statistics, quantiles
from yardframe.operators.joins import (
    fits_broadcast, lookup_join, natural_left_join, role_join, settle, suffixed_left_join,
)
from yardframe.operators.rows import (
    dense_rank_within, first_per_key, pivot_mean, sort_asc, sort_desc,
)


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "z")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("a", 11), (None, 20), ("b", 30)], "k2 string, v int")
    return left, right


@pytest.mark.parametrize("cells", [None, 0])
def test_null_keys_and_fan_out(sides, rows_of, cells):
    """Both join forms agree: broadcast, and salted for a side past the bound."""
    left, right = sides
    plain = lookup_join(left, right, {"k": "k2"}, cells=cells)
    safe = lookup_join(left, right, {"k": "k2"}, null_safe=True, cells=cells)
    assert plain.columns == ["id", "k", "v"]
    assert rows_of(plain, "id", "v") == [(1, 10), (1, 11), (2, None), (3, 30), (4, None)]
    assert rows_of(safe, "id", "v") == [(1, 10), (1, 11), (2, 20), (3, 30), (4, None)]


def test_large_side_is_not_broadcast(sides):
    left, right = sides
    joined = lookup_join(left, right.withColumn("v", F.col("v") + 1), {"k": "k2"}, cells=0)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    assert fits_broadcast(right) and not fits_broadcast(right, 1)


def test_salted_join_with_one_hot_key(spark):
    hot = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("k"))
    side = spark.createDataFrame([("hot", 1), ("1", 2)], "k string, v int")
    joined = lookup_join(hot, side, "k", cells=0)
    assert joined.count() == 3000
    assert joined.agg(F.sum("v")).first()[0] == 1000 + 2


def test_natural_and_suffixed_joins(spark, rows_of):
    a = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "id string, x double")
    b = spark.createDataFrame([("p", 5.0)], "id string, y double")
    assert rows_of(natural_left_join(a, b)) == [("p", 1.0, 5.0), ("q", 2.0, None)]
    with pytest.raises(ValueError):
        natural_left_join(a, b.withColumnsRenamed({"id": "other"}))
    clash = suffixed_left_join(a, spark.createDataFrame([("p", 9.0)], "id string, x double"), ["id"])
    assert clash.columns == ["id", "x_x", "x_y"]


def test_role_join_repeats_rows_for_repeated_players(spark, rows_of):
    plays = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "id int, passer_id string, receiver_id string")
    rosters = spark.createDataFrame([("a", "QB"), ("b", "WR"), ("b", "TE"), (None, "K")], "gsis_id string, position string")
    out = role_join(plays, rosters, {"passer_id": "pp", "receiver_id": "rp"})
    assert rows_of(out, "id", "pp", "rp") == [(1, "QB", "TE"), (1, "QB", "WR"), (2, "K", None)]


def test_first_row_ties_and_null_order(spark, rows_of):
    df = spark.createDataFrame([("g", None, 1, "x"), ("g", 5, 2, "y"), ("g", 5, 1, "z"), ("h", None, 1, "w")],
                               "k string, season int, tie int, v string")
    assert rows_of(first_per_key(df, ["k"], [F.col("season"), F.col("tie")]), "k", "v") == [("g", "z"), ("h", "w")]
    assert rows_of(first_per_key(df, ["k"], [-F.col("season"), -F.col("tie")]), "k", "v") == [("g", "y"), ("h", "w")]


def test_dense_rank_with_ties(spark, rows_of):
    df = spark.createDataFrame([("a", 1, 9), ("b", 1, 9), ("c", 1, 4), ("d", 2, 4)], "id string, season int, carries int")
    out = dense_rank_within(df, "season", "carries", "rank")
    assert rows_of(out, "id", "rank") == [("a", 1), ("b", 1), ("c", 2), ("d", 1)]


def test_sorts_put_nulls_last(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 5.0)], "id int, v double")
    assert [r.id for r in sort_desc(df, "v", "id").collect()] == [3, 1, 2]
    assert [r.id for r in sort_asc(df, "v", "id").collect()] == [1, 3, 2]


def test_pivot(spark, rows_of):
    df = spark.createDataFrame([("t", "pass", 1.0), ("t", "pass", 3.0), ("u", "run", 2.0), ("u", "punt", 9.0)],
                               "team string, kind string, epa double")
    out = pivot_mean(df, "team", "kind", "epa", {"pass": "p", "run": "r"})
    assert rows_of(out, "team", "p", "r") == [("t", 2.0, None), ("u", None, 2.0)]


def test_settled_rows_stay(spark, rows_of):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    assert rows_of(settle(df.groupBy("k").count())) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("values", [
    [float(v % 23 - 3) for v in range(500)],
    [random.Random(4).gauss(0, 1) * 10 ** (i % 5) for i in range(700)],
    [1.0] * 400 + [math.pi], [7.0], [2.0, None, 2.0, None, 9.5],
])
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "y double").repartition(5)
    shares = [0.0, 0.25, 0.5, 0.75, 1.0]
    expected = np.quantile([v for v in values if v is not None], shares)
    assert quantiles(df, "y", shares) == pytest.approx(list(expected), rel=1e-12)


def test_order_statistics_reject_bad_rank(spark):
    with pytest.raises(ValueError):
        order_statistics(spark.createDataFrame([(1.0,)], "y double"), "y", [1])


def test_hash_cutoffs_keep_exact_counts(spark):
    rows = [(i % 3 if i % 2 else 0, hashlib.md5(str(i).encode()).hexdigest()) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, d string")
    take = {0: 700, 1: 1, 2: sum(g == 2 for g, _ in rows)}
    cutoffs = hash_cutoffs(df, "g", "d", take)
    kept = {r["g"]: r["count"] for r in
            df.filter(at_most(F.col("d"), F.col("g"), cutoffs)).groupBy("g").count().collect()}
    assert kept == take
    assert cutoffs[0] == sorted(d for g, d in rows if g == 0)[699]
