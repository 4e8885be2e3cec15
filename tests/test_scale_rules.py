"""Plans and operators that must hold at any size: one scan, ranges, pruned folders, grouping sets."""

import re

from pyspark.sql import functions as F

from yardframe.catalog.base import Inputs
from yardframe.operators.joins import one_row_per_player, role_join
from yardframe.operators.rows import dense_rank_within
from yardframe.plans.player_plays import player_plays
from yardframe.plans.ratings import workload_table
from yardframe.sources import tables

FOLDER = "/root/testdata/sf0.001"


def test_rank_of_a_million_distinct_values(spark):
    rows = spark.range(1_000_000).select(F.lit("a").alias("g"), (F.col("id") * 3).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("b", 7), ("b", 9), ("b", 7), ("b", None), (None, 4)], "g string, v long"))
    ranked = dense_rank_within(rows, "g", "v", "rank")
    wrong = ranked.filter((F.col("g") == "a") & (F.col("rank") != 1_000_000 - F.col("v") / 3))
    assert wrong.isEmpty()
    rest = sorted(map(tuple, ranked.filter("g is null or g = 'b'").collect()), key=str)
    assert rest == sorted([("b", 7, 2), ("b", 9, 1), ("b", 7, 2), ("b", None, None), (None, 4, 1)], key=str)


def test_no_task_ranks_a_whole_group(spark):
    rows = spark.range(20_000).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.distinct().repartitionByRange(parts, "g", F.desc("v")).groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 20_000 / 2
    assert dense_rank_within(rows, "g", "v", "r").agg(F.max("r")).first()[0] == 20_000


def test_player_plays_reads_the_plays_once(spark, tmp_path):
    inputs = Inputs(spark, FOLDER)
    inputs.plays.write.parquet(str(tmp_path / "plays"))
    plays = tables.scan_plays(spark, str(tmp_path / "plays"))
    out = player_plays(plays, inputs.rosters)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[game_id", plan)) == 1
    both = plays.filter("receiver_id is not null").count() + plays.filter("rusher_id is not null").count()
    assert player_plays(plays, inputs.rosters, dedupe=True).count() == both


def test_dedupe_keeps_one_row_of_each_player(spark, rows_of):
    rosters = spark.createDataFrame([("p", 2002, "QB"), ("p", 2001, "WR"), ("p", 2001, "TE"), ("q", 2000, None), (None, 2000, "RB")],
                                    "gsis_id string, season int, position string")
    assert rows_of(one_row_per_player(rosters)) == [(None, "RB"), ("p", "TE"), ("q", None)]
    plays = spark.createDataFrame([(1, "p"), (2, "q"), (3, None), (4, "r")], "play_id int, passer_id string")
    assert role_join(plays, rosters, {"passer_id": "pos"}).count() == 6
    assert rows_of(role_join(plays, rosters, {"passer_id": "pos"}, dedupe=True)) == [
        (1, "p", "TE"), (2, "q", None), (3, None, "RB"), (4, "r", None)]


def test_workloads_from_grouping_sets(spark, rows_of):
    rows = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), ("b", "x")], "p string, r string")
    found = workload_table(rows, ["p", "r"])
    assert rows_of(found["p"]) == [(None, 1), ("a", 2), ("b", 1)]
    assert rows_of(found["r"]) == [(None, 1), ("x", 3)]


def test_refresh_reads_only_incoming_seasons(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    plays = Inputs(spark, FOLDER).plays
    tables.append_new_games(plays, path)
    seen = []
    plain = tables.missing_games
    monkeypatch.setattr(tables, "missing_games", lambda incoming, existing: (seen.append(existing), plain(incoming, existing))[1])
    season = plays.agg(F.max("season")).first()[0]
    before = spark.read.parquet(path).count()
    more = plays.filter(F.col("season") == season).limit(5).withColumn("game_id", F.concat(F.col("game_id"), F.lit("new")))
    tables.append_new_games(more.unionByName(plays.filter(F.col("season") == season)), path)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*season", plan)
    assert spark.read.parquet(path).count() == before + 5
