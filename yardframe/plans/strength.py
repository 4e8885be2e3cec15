"""Team offence and defence strength from mean EPA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import row_count
from yardframe.functions.text import unite
from yardframe.operators.joins import lookup_join, settle
from yardframe.operators.rows import pivot_mean


def team_strength(plays: DataFrame) -> DataFrame:
    """Mean EPA of a team's passes and runs, one row per team."""
    return pivot_mean(plays, "posteam", "play_type", "epa",
                      {"pass": "pass_strength", "run": "rush_strength"})


def offense_strength(pass_plays: DataFrame, run_plays: DataFrame) -> DataFrame:
    """Pass plays with the run and pass strength of the team on offence."""
    run = run_plays.groupBy("posteam").agg(F.avg("epa").alias("run_strength"))
    passing = pass_plays.groupBy("posteam").agg(F.avg("epa").alias("pass_strength"))
    both = lookup_join(passing, settle(run), "posteam", null_safe=True, salt_on=["posteam"])
    return lookup_join(pass_plays, settle(both), "posteam", null_safe=True)


def defense_strength(plays: DataFrame) -> DataFrame:
    """Dropbacks faced and sign-flipped mean EPA by defence and season."""
    return plays.groupBy("defteam", "season").agg(
        row_count().alias("dropbacks"), (-F.avg("epa")).alias("def_strength"))


def with_defense_strength(plays: DataFrame) -> DataFrame:
    return lookup_join(plays, settle(defense_strength(plays)), ["defteam", "season"], null_safe=True)


def defense_strength_split(plays: DataFrame) -> DataFrame:
    """Pass and run strength by the united key ``def_season``, for defences that faced a pass.

    One scan gives both means; a defence that faced no run has a null run strength.
    """
    is_pass, is_run = F.col("play_type") == "pass", F.col("play_type") == "run"
    means = (
        plays.filter(is_pass | is_run)
        .groupBy("defteam", "season")
        .agg((-F.avg(F.when(is_pass, F.col("epa")))).alias("def_strength_pass"),
             (-F.avg(F.when(is_run, F.col("epa")))).alias("def_strength_run"),
             F.count(F.when(is_pass, F.lit(1))).alias("passes"))
        .filter(F.col("passes") > 0)
        .drop("passes")
    )
    return unite(means, "def_season", ["defteam", "season"], keep=False)
