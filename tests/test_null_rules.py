"""Null rules of conditionals, text joins, sums, means, casts and ids."""

from pyspark.sql import functions as F

from yardframe.functions.nulls import (
    if_else, null_fill, paste, ratio, strict_mean, strict_mean_where, strict_sum, sum_where,
    threshold_flag, weighted_mean,
)
from yardframe.functions.text import (
    decode_player_ids, season_of_game, separate, to_integer, unite,
)


def test_conditional_keeps_null(spark, rows_of):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, t boolean")
    assert rows_of(df.select("k", if_else(F.col("t"), F.lit("yes"), F.lit("no")))) == [
        (1, "yes"), (2, "no"), (3, None)]


def test_threshold_flag(spark, rows_of):
    df = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, None)], "k int, v double")
    assert rows_of(df.select("k", threshold_flag("v", 0))) == [(1, 1), (2, 0), (3, None)]


def test_text_join_writes_na(spark, rows_of):
    df = spark.createDataFrame([(1, "left", "end"), (2, "middle", None), (3, None, None)],
                               "k int, a string, b string")
    assert rows_of(df.select("k", paste("a", "b"))) == [(1, "left end"), (2, "middle NA"), (3, "NA NA")]
    united = unite(df, "ab", ["a", "b"], keep=False)
    assert united.columns == ["k", "ab"]
    assert rows_of(united)[1] == (2, "middle_NA")
    assert unite(df, "ab", ["a", "b"]).columns == ["k", "a", "b", "ab"]


def test_strict_and_plain_means(spark, rows_of):
    df = spark.createDataFrame(
        [("full", 1.0), ("full", 3.0), ("part", 1.0), ("part", None), ("none", None)], "g string, v double")
    out = df.groupBy("g").agg(strict_sum("v"), strict_mean("v"), F.sum("v"), F.avg("v"))
    assert rows_of(out) == [("full", 4.0, 2.0, 4.0, 2.0), ("none", None, None, None, None),
                            ("part", None, None, 1.0, 1.0)]


def test_conditional_sum_and_mean(spark, rows_of):
    df = spark.createDataFrame(
        [("a", 1, 5.0, 1.0), ("a", 0, 9.0, None), ("a", None, 9.0, None), ("b", 1, None, 2.0), ("b", 1, 4.0, 2.0)],
        "g string, flag int, y double, air double")
    out = df.groupBy("g").agg(sum_where("y", F.col("flag") == 1),
                              strict_mean_where("y", F.col("air").isNotNull()))
    assert rows_of(out) == [("a", 5.0, 5.0), ("b", 4.0, None)]


def test_zero_divisor_gives_null(spark, rows_of):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 4.0, 0.0), (3, None, 2.0)], "k int, a double, b double")
    assert rows_of(df.select("k", ratio("a", "b"))) == [(1, 2.0), (2, None), (3, None)]
    assert df.limit(0).agg(weighted_mean("a", "b")).first()[0] is None


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1)], "r double, n int")
    assert df.agg(weighted_mean("r", "n")).first()[0] == 2.0


def test_bad_text_is_null(spark, rows_of):
    df = spark.createDataFrame([("2019_x",), ("abcd_x",), (None,)], "g string")
    assert rows_of(df.select("g", season_of_game(F.col("g")))) == [
        (None, None), ("2019_x", 2019), ("abcd_x", None)]
    assert df.limit(1).select(to_integer(F.lit("12"))).first()[0] == 12


def test_separate_pads_and_drops(spark, rows_of):
    df = spark.createDataFrame([("a_1",), ("b",), ("c_2_x",), (None,)], "k string")
    assert rows_of(separate(df, "k", ["id", "n"])) == [
        (None, None, None), ("a_1", "a", "1"), ("b", "b", None), ("c_2_x", "c", "2")]


def test_hex_ids(spark, rows_of):
    df = spark.createDataFrame([(1, "32013030-2d30-3032-3739-333400a1b2c3"), (2, "00-0027934"), (3, None)],
                               "k int, rusher_id string")
    assert rows_of(decode_player_ids(df)) == [(1, "00-0027934"), (2, "00-0027934"), (3, None)]


def test_null_fill(spark, rows_of):
    df = spark.createDataFrame([(1, None), (2, "end")], "k int, gap string")
    assert rows_of(df.select("k", null_fill("gap", "Other"))) == [(1, "Other"), (2, "end")]
