"""The analyses on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from yardframe.plans import expected, player_plays, ratings, splits, strength, war


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_third_downs_with_an_unknown_result(spark, rows_of):
    schema = ("game_id string, posteam string, passer string, season_type string, down int, ydstogo int, "
              "incomplete_pass int, third_down_converted int, air_yards double")
    plays = frame(spark, schema, [
        ("2001_1", "T", "P", "REG", 3, 8, 0, 1, 5.0), ("2001_1", "T", "P", "REG", 3, 10, 1, 0, None),
        ("2001_2", "T", "Q", "REG", 3, 9, None, 0, 4.0), ("2001_2", "T", "Q", "REG", 2, 9, 0, 0, 4.0),
        ("2001_2", "U", "Q", "REG", 3, 9, 0, 0, 4.0), ("2001_2", "T", "Q", "REG", 3, 6, 0, 0, 4.0)])
    assert rows_of(splits.third_and_long(plays, "T")) == [
        (2001, "P", "REG", 2, 1, 1, 9.0, 5.0, 0.5, 0.5), (2001, "Q", "REG", 1, None, 0, 9.0, 4.0, None, 0.0)]


@pytest.mark.parametrize("perspective,expected_play", [("possession", 2), ("team", 3)])
def test_first_low_moment(spark, perspective, expected_play):
    schema = ("game_id string, play_id bigint, season int, home_team string, away_team string, posteam string, "
              "wp double, game_seconds_remaining int, game_half string")
    plays = frame(spark, schema, [
        ("g", 1, 2012, "T", "U", "T", 0.05, 3600, "Half1"), ("g", 2, 2012, "T", "U", "U", 0.08, 3400, "Half1"),
        ("g", 3, 2012, "T", "U", "U", 0.95, 3300, "Half1"), ("g", 4, 2012, "T", "U", "T", 0.01, 1700, "Half2"),
        ("h", 1, 2009, "T", "U", "T", 0.01, 3000, "Half1"), ("k", 1, 2012, "V", "U", "V", 0.01, 3000, "Half1")])
    found = splits.low_win_prob_first(plays, "T", perspective=perspective).collect()
    assert [r["play_id"] for r in found] == [expected_play]


def test_receiver_without_a_catch(spark):
    schema = ("posteam string, season int, play_type string, receiver_id string, receiver_player_name string, "
              "pass_attempt int, complete_pass int, yards_gained double, air_yards double, yards_after_catch double")
    plays = frame(spark, schema, [
        ("T", 2015, "pass", "a", "A", 1, 1, 10.0, 6.0, 4.0), ("T", 2015, "pass", "b", "B", 1, 0, 0.0, None, None),
        ("T", 2015, "pass", None, None, 1, 0, 0.0, 3.0, None), ("T", 2014, "pass", "a", "A", 1, 1, 9.0, 6.0, 3.0)])
    found = {r["receiver_id"]: r for r in splits.receiver_relative(plays, "T", range(2015, 2020)).collect()}
    assert set(found) == {"a", "b", None}
    assert found["b"]["receiver_ypc"] is None and found["b"]["rec_yards"] is None
    assert found["a"]["team_dropbacks"] == 3 and found["a"]["relative_comp"] == pytest.approx(3.0)
    totals = splits.team_pass_totals(plays, "T", range(2015, 2020)).first()
    assert totals["team_ypa"] == pytest.approx(10 / 3) == found["a"]["team_ypa"]


def test_gap_labels(spark, rows_of):
    plays = frame(spark, "id int, posteam string, play_type string, run_location string, run_gap string", [
        (1, "T", "run", "left", "end"), (2, "T", "run", "middle", None), (3, "T", "run", None, None),
        (4, "T", "pass", None, None), (5, "T", "run", "right", None), (6, None, "run", "left", "end")])
    assert rows_of(player_plays.with_gap_labels(plays), "id", "location_gap", "team_location_gap") == [
        (1, "left end", "T left end"), (2, "middle", "T middle"), (3, None, "T NA"), (4, None, None),
        (5, "right NA", "T right NA"), (6, "left end", "NA left end")]


def test_a_play_with_two_roles_appears_twice(spark, rows_of):
    plays = frame(spark, "id int, posteam string, play_type string, run_location string, run_gap string, "
                         "passer_id string, receiver_id string, rusher_id string", [
        (1, "T", "pass", None, None, "q", "r", "s"), (2, "T", "run", "left", "end", None, None, "s"),
        (3, "T", "punt", None, None, None, None, None)])
    rosters = frame(spark, "gsis_id string, position string", [("q", "QB"), ("r", "WR"), ("s", "RB")])
    out = player_plays.player_plays(plays, rosters)
    assert rows_of(out, "id", "passer_position", "rec_position", "rush_position") == [
        (1, None, None, "RB"), (1, "QB", "WR", None), (2, None, None, "RB")]


def test_defense_strength_keys(spark, rows_of):
    plays = frame(spark, "defteam string, season int, play_type string, epa double", [
        ("T", 2001, "pass", 1.0), ("T", 2001, "pass", None), ("T", 2001, "run", 0.5), ("U", 2001, "run", 0.5),
        (None, 2001, "pass", 2.0)])
    assert rows_of(strength.defense_strength_split(plays), "def_season", "def_strength_pass", "def_strength_run") == [
        ("NA_2001", -2.0, None), ("T_2001", -1.0, -0.5)]


def test_eras(spark, rows_of):
    seasons = frame(spark, "season int", [(1999,), (2002,), (2013,), (2017,), (2020,), (None,)])
    assert rows_of(seasons.select("season", expected.era_of(F.col("season")))) == [
        (None, 5), (1999, 1), (2002, 2), (2013, 3), (2017, 4), (2020, 5)]


def test_rusher_leaderboard(spark):
    scored = frame(spark, "rusher_id string, season int, posteam string, yards_gained double, exp_pred double",
                   [("a", 2001, "T", 5.0, 3.0)] * 20 + [("b", 2001, "T", 5.0, 3.0)] * 19
                   + [("c", 2001, "T", 5.0, 3.0)] * 19 + [("c", 2001, "T", 5.0, None), (None, 2001, "T", 1.0, 1.0)])
    rosters = frame(spark, "season int, team string, gsis_id string, full_name string, position string, height int, weight int",
                    [(2000, "U", "a", "A", "RB", 70, 200), (1998, "T", "a", "A", "QB", 69, 190)])
    found = {r["rusher_id"]: r for r in expected.rusher_over_expected(scored, rosters).collect()}
    assert set(found) == {"a", "c"}
    assert (found["a"]["rookie_year"], found["a"]["position"], found["a"]["years_in_league"]) == (1998, "QB", 3)
    assert found["a"]["total_diff"] == pytest.approx(40.0)
    assert found["c"]["expected_ypa"] is None and found["c"]["years_in_league"] is None


def test_back_transform(spark):
    row = spark.range(1).select(expected.back_transform(F.lit(1.0)), expected.back_transform(F.lit(1.0), "sinh")).first()
    assert row[0] == pytest.approx(2.718281828) and row[1] == pytest.approx(1.175201194)


def test_pooling_at_the_rank_limit(spark, rows_of):
    runs = frame(spark, "game_id string, play_id bigint, rusher_id string, season int",
                 [("g", i, who, 2001) for i, who in enumerate("aaabbc")])
    ranks = war.carries_rank(runs)
    assert rows_of(ranks, "rusher_id", "carries", "rank_carries") == [("a", 3, 1), ("b", 2, 2), ("c", 1, 3)]
    pooled = war.pool_replacement(runs, ranks, max_rank=2)
    assert {r[0] for r in rows_of(pooled, "rusher_season")} == {"a_2001", "b_2001", "replacement-level_2001"}


def test_war_of_a_replacement_level_player_is_zero(spark):
    labels = war.with_label_parts(frame(spark, "rusher_season string, wpa_average double", [
        ("a_2001", 0.02), ("b_2001", 0.05), ("replacement-level_2001", 0.02)]))
    ranks = frame(spark, "season int, rusher_season string, rusher_id string, carries bigint",
                  [(2001, "a_2001", "a", 10), (2001, "b_2001", "b", 20)])
    first = frame(spark, "rookie_year int, gsis_id string, full_name string, position string, height int, weight int",
                  [(1999, "a", "A", "RB", 70, 200), (2001, "b", "B", "RB", 70, 200)])
    table = war.wins_above_replacement(labels, ranks, first)
    rows = {r["rusher_season"]: r for r in table.collect()}
    assert rows["a_2001"]["rushing_war"] == 0.0
    assert rows["b_2001"]["rushing_war"] == pytest.approx(0.6)
    assert rows["replacement-level_2001"]["carries"] is None
    career = {r["rusher_id"]: r for r in war.war_career(table).collect()}
    assert career[None]["total_war"] is None
    assert (career["a"]["seasons_above_zero"], career["b"]["seasons_above_zero"]) == (0, 1)
    assert career["b"]["wpa_per_carry"] == pytest.approx(0.03)
    numbered = {r["rusher_id"]: r["season_number"] for r in war.war_by_season_number(table).collect()}
    assert (numbered["a"], numbered["b"]) == (2, 0)
    assert [r["rusher_id"] for r in war.war_span(table, [2001]).collect()] == ["b", "a"]


def test_team_weighted_rating_refuses_nulls(spark, rows_of):
    passers = frame(spark, "team string, epa_with_rec double, attempts bigint",
                    [("T", 0.1, 100), ("T", 0.3, 300), ("U", None, 10), ("U", 0.2, 10)])
    assert rows_of(ratings.team_weighted_rating(passers), "team", "team_ipa_avg") == [
        ("T", pytest.approx(0.25)), ("U", None)]


def test_raw_relative_uses_the_ratio_of_magnitudes(spark):
    passes = frame(spark, "receiver string, posteam string, rec_position string, epa double",
                   [("r", "T", "WR", -0.4)] * 2 + [("s", "T", "WR", 0.2)] * 2)
    found = {r["receiver"]: r["relative_epa"] for r in ratings.receiver_raw_relative(passes, 2).collect()}
    assert found == {"r": pytest.approx(4.0), "s": pytest.approx(2.0)}


def test_line_searches_agree_on_what_they_read(spark):
    from yardframe.catalog.base import Inputs

    tables = Inputs(spark, "/root/testdata/sf0.001")
    players = player_plays.player_plays(tables.plays, tables.rosters.filter("season = 2001"))
    fixed, random, search = ratings.line_selection(players)
    terms = {t.name for t in ratings.LINE_TERMS}
    assert {r["term"] for r in fixed.collect()} <= terms
    assert {r["factor"] for r in random.collect()} <= set(ratings.LINE_GROUPS)
    assert [r["nvmax"] for r in search.results.orderBy("nvmax").collect()] == list(range(1, 8))
    assert 1 <= search.best_size <= 7
    assert search.coefficients.count() == search.best_size + 1
