"""Efficiency splits of passers, receivers and teams, and the tables behind their charts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import (
    if_else, ratio, row_count, strict_mean, strict_mean_where, strict_sum, sum_where,
)
from yardframe.functions.text import season_of_game
from yardframe.operators.joins import lookup_join, settle
from yardframe.operators.rows import first_per_key, sort_desc
from yardframe.sources.tables import in_seasons


def third_and_long(plays: DataFrame, team: str, down: int = 3, min_distance: int = 7) -> DataFrame:
    """Passer results on long third downs by year and season type."""
    long_downs = plays.filter(
        (F.col("posteam") == team) & (F.col("down") == down) & (F.col("ydstogo") >= min_distance))
    return (
        long_downs
        .withColumns({
            "year": season_of_game(F.col("game_id")),
            "complete": if_else(F.col("incomplete_pass") == 0, F.lit(1), F.lit(0)),
        })
        .groupBy("year", "passer", "season_type")
        .agg(row_count().alias("attempts"),
             strict_sum("complete").alias("completions"),
             strict_sum("third_down_converted").alias("conversions"),
             strict_mean("ydstogo").alias("avg_distance"),
             F.avg("air_yards").alias("avg_airyards"))
        .withColumns({
            "completion_pct": ratio("completions", "attempts"),
            "conversion_pct": ratio("conversions", "attempts"),
        })
    )


def low_win_prob_first(plays: DataFrame, team: str, first_season: int = 2010,
                       limit: float = 0.10, clock: int = 3600, half: str = "Half1",
                       perspective: str = "possession") -> DataFrame:
    """The earliest first-half play of each of a team's games at or below a win probability.

    ``perspective="possession"`` tests the win probability of the team with the ball;
    ``"team"`` tests that of the given team.
    """
    tested = {"possession": "wp", "team": "team_wp"}[perspective]
    games = (
        plays.filter((F.col("home_team") == team) | (F.col("away_team") == team))
        .withColumn("team_wp", if_else(F.col("posteam") == team, F.col("wp"), 1 - F.col("wp")))
        .filter((F.col("season") >= first_season) & (F.col(tested) <= limit)
                & (F.col("game_seconds_remaining") < clock) & (F.col("game_half") == half))
    )
    return first_per_key(games, ["game_id"], [-F.col("game_seconds_remaining"), F.col("play_id")])


def plays_by_epa(plays: DataFrame, team: str) -> DataFrame:
    return sort_desc(plays.filter(F.col("posteam") == team), "epa", "game_id", "play_id")


def passer_epa_season(plays: DataFrame, team: str, min_attempts: int = 50) -> DataFrame:
    """A team's passers by season; one play without EPA makes the mean null."""
    return (
        plays.filter((F.col("posteam") == team) & F.col("passer").isNotNull())
        .groupBy("passer", "season")
        .agg(row_count().alias("attempts"), strict_mean("epa").alias("avg_epa"))
        .filter(F.col("attempts") >= min_attempts)
    )


def passer_epa_all(plays: DataFrame, min_attempts: int = 100) -> DataFrame:
    return (
        plays.filter(F.col("passer").isNotNull())
        .groupBy("passer", "posteam", "season")
        .agg(row_count().alias("attempts"), F.avg("epa").alias("avg_epa"))
        .filter(F.col("attempts") >= min_attempts)
    )


def passer_epa_slice(plays: DataFrame, season: int, min_attempts: int = 100) -> DataFrame:
    """One season of ``passer_epa_all``; the season test reaches the scan as it is a grouping key."""
    return passer_epa_all(plays, min_attempts).filter(F.col("season") == season)


def _pass_sums() -> dict[str, Column]:
    return {
        "plays": row_count(),
        "attempts": F.sum("pass_attempt"),
        "completions": F.sum("complete_pass"),
        "yards": sum_where("yards_gained", F.col("complete_pass") == 1),
        "air": F.sum("air_yards"),
        "yac": F.sum("yards_after_catch"),
    }


def _team_passes(plays: DataFrame, team: str, seasons: Iterable[int]) -> DataFrame:
    return in_seasons(plays.filter((F.col("posteam") == team) & (F.col("play_type") == "pass")), seasons)


def _with_team_rates(totals: DataFrame) -> DataFrame:
    return totals.select(
        "season",
        F.col("plays").alias("team_dropbacks"), F.col("attempts").alias("team_attempts"),
        F.col("completions").alias("team_completions"), F.col("yards").alias("team_passyards"),
        F.col("air").alias("team_air_yards"), F.col("yac").alias("team_yac"),
        ratio("yards", "attempts").alias("team_ypa"),
        ratio("yards", "plays").alias("team_ypd"),
        ratio("completions", "attempts").alias("team_comp_pct"),
    )


def team_pass_totals(plays: DataFrame, team: str, seasons: Iterable[int]) -> DataFrame:
    totals = (_team_passes(plays, team, seasons).groupBy("season")
              .agg(*[total.alias(name) for name, total in _pass_sums().items()]))
    return _with_team_rates(totals)


def receiver_relative(plays: DataFrame, team: str, seasons: Iterable[int]) -> DataFrame:
    """Receiver totals by season with their efficiency relative to the whole team.

    The plays are read once: team totals are rolled up from the stored receiver totals.
    """
    players = settle(
        _team_passes(plays, team, seasons)
        .groupBy("season", "receiver_id", "receiver_player_name")
        .agg(*[total.alias(name) for name, total in _pass_sums().items()])
    )
    team_totals = _with_team_rates(
        players.groupBy("season").agg(*[F.sum(name).alias(name) for name in _pass_sums()]))
    receivers = players.select(
        "season", "receiver_id", "receiver_player_name",
        F.col("plays").alias("targets"), F.col("completions").alias("receptions"),
        F.col("yards").alias("rec_yards"), F.col("air").alias("rec_airyards"),
        F.col("yac").alias("rec_yac"),
        ratio("yards", "plays").alias("receiver_ypt"),
        ratio("yards", "completions").alias("receiver_ypc"),
        ratio("completions", "plays").alias("receiver_comp_pct"),
    )
    return lookup_join(receivers, team_totals, "season", salt_on=["receiver_id"]).withColumns({
        "relative_comp": ratio("receiver_comp_pct", "team_comp_pct"),
        "relative_ypa": ratio("receiver_ypt", "team_ypa"),
    })


def team_air_yac(plays: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    """Team passing averages split into air yards and yards after the catch."""
    passes = (
        plays.filter((F.col("play_type") == "pass") & (F.col("season") == season))
        .groupBy("posteam")
        .agg(row_count().alias("dropbacks"),
             F.avg("epa").alias("avg_pass_epa"),
             F.avg("air_yards").alias("avg_airyards"),
             F.avg("yards_after_catch").alias("avg_yac"),
             F.avg("yards_gained").alias("avg_yards_gained_pass"),
             strict_mean_where("yards_gained", F.col("air_yards").isNotNull()).alias("avg_ypa"))
        .withColumn("avg_total_pass", F.col("avg_airyards") + F.col("avg_yac"))
        .withColumns({"airyard_pct": ratio("avg_airyards", "avg_total_pass"),
                      "yac_pct": ratio("avg_yac", "avg_total_pass")})
    )
    return lookup_join(passes, teams, {"posteam": "team_abbr"}, null_safe=True, salt_on=["posteam"])


def team_rush_eff(plays: DataFrame, season: int) -> DataFrame:
    return (
        plays.filter((F.col("play_type") == "run") & (F.col("season") == season))
        .groupBy("posteam")
        .agg(row_count().alias("carries"), F.avg("epa").alias("avg_run_epa"),
             F.avg("yards_gained").alias("avg_yards_run"))
    )


def team_pass_run(plays: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    return lookup_join(team_air_yac(plays, teams, season), settle(team_rush_eff(plays, season)),
                       "posteam", null_safe=True, salt_on=["posteam"])


def _chart_feed(table: DataFrame, x: str, y: str, size: str, per_point: float) -> DataFrame:
    """Points with their size, the two mean lines and the least-squares line of ``y`` on ``x``."""
    table = settle(table)
    lines = table.agg(
        strict_mean(x).alias("mean_x"), strict_mean(y).alias("mean_y"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
    ).first()
    return table.select(
        "posteam", "team_color", F.col(x).alias("x"), F.col(y).alias("y"),
        (F.col(size) / F.lit(per_point)).alias("point_size"),
        *[F.lit(lines[name]).cast("double").alias(name)
          for name in ("mean_x", "mean_y", "slope", "intercept")],
    )


def feed_run_pass(plays: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    return _chart_feed(team_pass_run(plays, teams, season), "avg_run_epa", "avg_pass_epa",
                       "carries", 75)


def feed_yards_epa(plays: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    return _chart_feed(team_pass_run(plays, teams, season), "avg_yards_gained_pass",
                       "avg_pass_epa", "dropbacks", 60)
