"""Wins above replacement for running backs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import if_else, paste, ratio, row_count, strict_sum, threshold_flag
from yardframe.functions.text import decode_player_ids, separate, to_integer, unite
from yardframe.models.design import Factor, Numeric
from yardframe.models.mixed import MixedFit, fit_mixed
from yardframe.operators.joins import lookup_join, settle
from yardframe.operators.rows import dense_rank_within, sort_desc
from yardframe.plans.expected import first_roster_rows
from yardframe.plans.strength import defense_strength_split
from yardframe.sources.tables import in_seasons

RUN_COLUMNS = (
    "rusher_id", "posteam_type", "posteam", "defteam", "yardline_100", "half_seconds_remaining",
    "game_half", "down", "ydstogo", "shotgun", "no_huddle", "run_gap", "run_location",
    "score_differential", "season", "roof", "yards_gained", "wpa", "epa",
)


def back_runs(plays: DataFrame, rosters: DataFrame, position: str = "RB",
              first_rows: DataFrame | None = None) -> DataFrame:
    """Runs by players of one position, with gap and defence keys and the first roster row.

    ``first_rows`` passes on already settled first roster rows.
    """
    runs = (plays.filter((F.col("play_type") == "run") & F.col("rusher_id").isNotNull())
                 .select("game_id", "play_id", *RUN_COLUMNS))
    runs = unite(runs, "team_run_gap", ["posteam", "run_location", "run_gap"])
    runs = decode_player_ids(unite(runs, "def_season", ["defteam", "season"]))
    if first_rows is None:
        first_rows = settle(first_roster_rows(rosters))
    joined = lookup_join(runs, first_rows, {"rusher_id": "gsis_id"}, null_safe=True)
    return joined.filter((F.col("position") == position) & F.col("rusher_id").isNotNull())


def with_run_defense(runs: DataFrame, plays: DataFrame) -> DataFrame:
    return lookup_join(runs, settle(defense_strength_split(plays)), "def_season", null_safe=True)


def carries_rank(runs: DataFrame) -> DataFrame:
    """Carries by rusher and season with their dense rank in the season."""
    carries = settle(runs.groupBy("rusher_id", "season").agg(row_count().alias("carries")))
    ranked = dense_rank_within(carries, "season", "carries", "rank_carries")
    return unite(ranked, "rusher_season", ["rusher_id", "season"])


def pool_replacement(runs: DataFrame, ranks: DataFrame, max_rank: int = 64) -> DataFrame:
    """Label runs by rusher-season; those ranked past ``max_rank`` share one label per season."""
    keyed = unite(runs, "rusher_season", ["rusher_id", "season"])
    ranked = lookup_join(keyed, ranks.select("rusher_season", "carries", "rank_carries"),
                         "rusher_season", null_safe=True)
    pooled = paste(F.lit("replacement-level"), "season", sep="_")
    return ranked.withColumn("rusher_season", if_else(
        F.col("rank_carries") <= max_rank, F.col("rusher_season"), pooled))


WPA_TERMS = (Factor("posteam_type"), Factor("shotgun"), Factor("no_huddle"),
             Numeric("def_strength_pass"))
WPA_GROUPS = ("rusher_season", "def_season", "team_run_gap")


def fit_wpa(pooled: DataFrame) -> MixedFit:
    return fit_mixed(pooled, F.col("wpa"), WPA_TERMS, list(WPA_GROUPS))


def rusher_season_ratings(fit: MixedFit) -> DataFrame:
    """Win probability added per carry by rusher-season label, with the label's parts."""
    table = fit.group_intercepts("rusher_season").select(
        F.col("level").alias("rusher_season"), F.col("intercept").alias("wpa_average"))
    return with_label_parts(table)


def with_label_parts(table: DataFrame) -> DataFrame:
    parts = separate(table, "rusher_season", ["rusher_id", "season"])
    return parts.withColumn("season_n", to_integer(F.col("season")))


def replacement_level(ratings: DataFrame) -> DataFrame:
    """The pooled label's rating by season."""
    return (ratings.filter(F.col("rusher_id").rlike("replacement"))
                   .select("season_n", F.col("wpa_average").alias("replacement_level")))


def wins_above_replacement(ratings: DataFrame, ranks: DataFrame, first_rows: DataFrame) -> DataFrame:
    """Wins, replacement wins and their difference by rusher-season label.

    The pooled labels match no rusher, so their carries, season and wins are null.
    """
    carries = lookup_join(ranks.select("season", "rusher_season", "rusher_id", "carries"), first_rows,
                          {"rusher_id": "gsis_id"}, null_safe=True, salt_on=["rusher_season"])
    carries = carries.withColumn("season_n", F.col("season").cast("int"))
    war = lookup_join(ratings.select("rusher_season", "wpa_average"), settle(carries), "rusher_season",
                      null_safe=True, salt_on=["rusher_season"])
    war = lookup_join(war, settle(replacement_level(ratings)), "season_n", null_safe=True,
                      salt_on=["rusher_season"])
    return (war.withColumns({"replacement_wins": F.col("replacement_level") * F.col("carries"),
                             "wins": F.col("wpa_average") * F.col("carries")})
               .withColumn("rushing_war", F.col("wins") - F.col("replacement_wins")))


def war_span(war: DataFrame, seasons: Iterable[int]) -> DataFrame:
    """Rows of several seasons, best first."""
    rows = in_seasons(war, seasons).select("season", "full_name", "rushing_war", "carries", "rusher_id")
    return sort_desc(rows, "rushing_war", "rusher_id", "season")


def war_season(war: DataFrame, season: int) -> DataFrame:
    return war.filter(F.col("season") == season)


def war_by_season_number(war: DataFrame) -> DataFrame:
    """Season of the career and whether it was above replacement."""
    return war.select(
        "rusher_id", "season", "full_name", "rushing_war", "carries", "wpa_average",
        "replacement_level", "rookie_year",
        (F.col("season") - F.col("rookie_year")).alias("season_number"),
        threshold_flag("rushing_war", 0).alias("above_zero"))


def war_career(war: DataFrame) -> DataFrame:
    """Career totals; the pooled labels form one group without a rusher."""
    totals = (
        war_by_season_number(war).groupBy("rusher_id", "full_name")
        .agg(strict_sum("carries").alias("total_carries"),
             strict_sum("rushing_war").alias("total_war"),
             strict_sum("above_zero").alias("seasons_above_zero"))
        .withColumn("wpa_per_carry", ratio("total_war", "total_carries"))
    )
    return sort_desc(totals, "total_war", "rusher_id", "full_name")


def running_back_war(plays: DataFrame, rosters: DataFrame, max_rank: int = 64) -> DataFrame:
    """The whole chain from plays and rosters to the wins-above-replacement table."""
    first_rows = settle(first_roster_rows(rosters))
    runs = back_runs(plays, rosters, first_rows=first_rows)
    ranks = settle(carries_rank(runs))
    fit = fit_wpa(pool_replacement(with_run_defense(runs, plays), ranks, max_rank))
    return wins_above_replacement(rusher_season_ratings(fit), ranks, first_rows)
