"""Passer, receiver, rusher and line ratings from mixed models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import ratio, row_count, strict_mean, strict_sum, without_nulls
from yardframe.models.design import Factor, Numeric
from yardframe.models.mixed import (
    MixedFit, backward_step, fit_gathered, fit_mixed, gather,
)
from yardframe.models.resample import SubsetSearch, cv_backward_subset
from yardframe.operators.joins import lookup_join, natural_left_join, settle
from yardframe.operators.rows import sort_desc
from yardframe.plans.player_plays import (
    LINE_MODEL_COLUMNS, line_model_rows, pass_model_rows, run_model_rows,
)


def workload(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Plays per key, for example the attempts of a passer."""
    return rows.groupBy(key).agg(row_count().alias(name))


def rating(fit: MixedFit, factor: str, name: str) -> DataFrame:
    """Group intercepts of one factor as ``factor``, ``name``."""
    return fit.group_intercepts(factor).select(F.col("level").alias(factor), F.col("intercept").alias(name))


def named_rating(ratings: DataFrame, key: str, name: str, rosters: DataFrame, loads: DataFrame,
                 load: str, above: int | None) -> DataFrame:
    """Ratings with player names and workload, best first, for players above a workload.

    ``loads`` is a small, already settled table.
    """
    people = rosters.select("gsis_id", "team", "position", "full_name")
    named = lookup_join(ratings, people, {key: "gsis_id"}, null_safe=True, salt_on=[key])
    counted = lookup_join(named, loads, key, null_safe=True, salt_on=[key])
    if above is not None:
        counted = counted.filter(F.col(load) > above)
    return sort_desc(counted, name, key)


PASSING_TERMS = (Factor("posteam_type"), Factor("shotgun"), Factor("no_huddle"),
                 Factor("pass_location"), Numeric("air_yards"), Numeric("rush_strength"))
RUSHING_TERMS = (Factor("posteam_type"), Factor("shotgun"), Factor("no_huddle"),
                 Numeric("pass_strength"))


def player_ratings(players: DataFrame, rosters: DataFrame, attempts: int = 150, targets: int = 35,
                   carries: int = 20, rushes: int = 10) -> dict[str, DataFrame]:
    """The four leaderboards: ``passer``, ``receiver``, ``rusher`` and ``line``.

    ``players`` comes from ``player_plays`` with team strength joined.
    """
    used = ["play_type", "epa", "passer_id", "receiver_id", "rusher_id", "team_location_gap",
            *dict.fromkeys(t.name for t in (*PASSING_TERMS, *RUSHING_TERMS))]
    kept = players.select(used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        passes, runs = pass_model_rows(kept), run_model_rows(kept)
        passing = fit_mixed(passes, F.col("epa"), PASSING_TERMS, ["passer_id", "receiver_id"])
        rushing = fit_mixed(runs, F.col("epa"), RUSHING_TERMS, ["rusher_id", "team_location_gap"])
        pass_loads = workload_table(passes, ["passer_id", "receiver_id"])
        run_loads = workload_table(runs, ["rusher_id", "team_location_gap"])
        loads = {key: table.withColumnRenamed("plays", name) for key, name, table in (
            ("passer_id", "attempts", pass_loads["passer_id"]), ("receiver_id", "targets", pass_loads["receiver_id"]),
            ("rusher_id", "carries", run_loads["rusher_id"]), ("team_location_gap", "rushes", run_loads["team_location_gap"]))}
    finally:
        kept.unpersist()
    line = lookup_join(rating(rushing, "team_location_gap", "line_rating"), loads["team_location_gap"],
                       "team_location_gap", null_safe=True, salt_on=["team_location_gap"])

    def board(fit: MixedFit, key: str, name: str, load: str, above: int) -> DataFrame:
        return named_rating(rating(fit, key, name), key, name, rosters, loads[key], load, above)

    return {
        "passer": board(passing, "passer_id", "passer_rating", "attempts", attempts),
        "receiver": board(passing, "receiver_id", "receiver_rating", "targets", targets),
        "rusher": board(rushing, "rusher_id", "rusher_rating", "carries", carries),
        "line": sort_desc(line.filter(F.col("rushes") > rushes), "line_rating", "team_location_gap"),
    }


SPLIT_TERMS = (Factor("posteam_type"), Factor("shotgun"), Factor("no_huddle"), Numeric("qb_hit"),
               Factor("pass_location"), Numeric("run_strength"))


def passing_fits(all_passes: DataFrame) -> tuple[MixedFit, MixedFit]:
    """The passing model with and without receivers, from one set of cross-products."""
    data = gather(all_passes, F.col("epa"), SPLIT_TERMS, ["passer_id", "receiver_id", "defteam"])
    return fit_gathered(data), fit_gathered(data.subset(factors=["passer_id", "defteam"]))


def passer_split(with_receivers: MixedFit, without: MixedFit) -> DataFrame:
    """Passer ratings of both models and their difference."""
    both = natural_left_join(rating(with_receivers, "passer_id", "epa_with_rec"),
                             rating(without, "passer_id", "epa_no_rec"))
    return both.withColumn("split", F.col("epa_with_rec") - F.col("epa_no_rec"))


def passing_boards(passer_fit: MixedFit, receiver_fit: MixedFit, passes: DataFrame, rosters: DataFrame,
                   year: str, attempts: int = 100) -> dict[str, DataFrame]:
    """Boards from the fits: ``passer``, ``team`` (attempt-weighted) and ``receiver`` against the team.

    ``passes`` are all passes, whose counts are the workloads; both fits may be the same.
    """
    loads = workload_table(passes, ["passer_id", "receiver_id"])
    passers = settle(named_rating(rating(passer_fit, "passer_id", "epa_with_rec"), "passer_id", "epa_with_rec", rosters,
                                  loads["passer_id"].withColumnRenamed("plays", "attempts"), "attempts", attempts))
    teams = team_weighted_rating(passers)
    receivers = named_rating(rating(receiver_fit, "receiver_id", "epa_rec"), "receiver_id", "epa_rec", rosters,
                             loads["receiver_id"].withColumnRenamed("plays", "targets"), "targets", None)
    return {"passer": passers, "team": teams, "receiver": receiver_relative_rating(receivers, teams, year)}


def workload_table(rows: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Plays by each key, from one scan: all keys are grouping sets of one stored table."""
    sets = rows.groupingSets([[k] for k in keys], *keys).agg(row_count().alias("plays"), F.grouping_id(*keys).alias("_set"))
    table = settle(sets)
    return {k: table.filter(F.col("_set") == _set_number(i, len(keys))).select(k, "plays") for i, k in enumerate(keys)}


def _set_number(i: int, size: int) -> int:
    """Grouping id of the set that holds only key ``i``: a bit is set for each key left out."""
    return (1 << size) - 1 - (1 << (size - 1 - i))


def team_weighted_rating(passers: DataFrame) -> DataFrame:
    """Attempt-weighted passer rating by team; expects ``team``, ``epa_with_rec``, ``attempts``."""
    return (
        passers.withColumn("total", F.col("epa_with_rec") * F.col("attempts"))
        .groupBy("team")
        .agg(strict_sum("total").alias("total_ipa_w_rec"),
             strict_sum("attempts").alias("total_attempts"))
        .withColumn("team_ipa_avg", ratio("total_ipa_w_rec", "total_attempts"))
    )


def receiver_relative_rating(receivers: DataFrame, team_ratings: DataFrame, year: str) -> DataFrame:
    """Receiver ratings against the passing of their team; expects ``epa_rec`` and ``targets``."""
    joined = lookup_join(receivers, settle(team_ratings), "team", null_safe=True, salt_on=["receiver_id"])
    rated = joined.select(
        "receiver_id", "position", "epa_rec", "team", "full_name", "targets", "total_attempts",
        "team_ipa_avg", F.lit(year).alias("year"),
        ratio("epa_rec", "team_ipa_avg").alias("relative_ipa"),
        (F.col("epa_rec") * F.col("targets")).alias("total_ipa"))
    return sort_desc(rated, "relative_ipa", "receiver_id")


def receiver_raw_relative(passes: DataFrame, min_targets: int = 50) -> DataFrame:
    """Receivers' plain mean EPA against that of their team's passes, as a positive ratio."""
    team = passes.groupBy("posteam").agg(strict_mean("epa").alias("avg_epa_passer"),
                                         row_count().alias("attempts"))
    receivers = passes.groupBy("receiver", "posteam", "rec_position").agg(
        strict_mean("epa").alias("avg_epa_receiver"), row_count().alias("targets"))
    joined = lookup_join(receivers, settle(team), "posteam", null_safe=True, salt_on=["receiver"])
    square = ratio(F.pow("avg_epa_receiver", F.lit(2)), F.pow("avg_epa_passer", F.lit(2)))
    return sort_desc(joined.withColumn("relative_epa", F.sqrt(square))
                           .filter(F.col("targets") >= min_targets),
                     "relative_epa", "receiver", "posteam")


LINE_TERMS = (
    Factor("posteam_type"), Factor("shotgun"), Numeric("yardline_100"), Numeric("down"),
    Numeric("game_seconds_remaining"), Numeric("goal_to_go"), Numeric("ydstogo"),
    Numeric("touchdown"), Factor("no_huddle"), Numeric("half_seconds_remaining"),
    Factor("game_half"), Numeric("fumble"), Factor("rush_position", ref="RB"),
)
LINE_GROUPS = ("team_location_gap", "rusher_id")
LINE_FINAL = ("posteam_type", "shotgun", "goal_to_go", "ydstogo", "touchdown", "fumble",
              "rush_position")


def line_selection(players: DataFrame, keys: Sequence[str] = ("game_id", "play_id")
                   ) -> tuple[DataFrame, DataFrame, SubsetSearch]:
    """Both variable searches of the line model: backward step tables, then cross-validated subsets."""
    rows = without_nulls(run_model_rows(players).select(*dict.fromkeys([*keys, *LINE_MODEL_COLUMNS])),
                         ["epa", "rush_position", "down"])
    fixed, random, _ = backward_step(gather(rows, F.col("epa"), LINE_TERMS, list(LINE_GROUPS)))
    return fixed, random, cv_backward_subset(rows, F.col("epa"), LINE_TERMS, keys)


def line_rating(players: DataFrame) -> DataFrame:
    """Rushing value added by each line position of a team, best first."""
    terms = [t for t in LINE_TERMS if t.name in LINE_FINAL]
    fit = fit_mixed(line_model_rows(players), F.col("epa"), terms, list(LINE_GROUPS))
    return sort_desc(rating(fit, "team_location_gap", "line_rating"), "line_rating", "team_location_gap")
