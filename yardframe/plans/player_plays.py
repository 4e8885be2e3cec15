"""The table of player plays and the row sets that the models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import null_fill, paste, without_nulls
from yardframe.functions.text import decode_player_ids
from yardframe.operators.joins import fits_broadcast, lookup_join, one_row_per_player, settle
from yardframe.plans.strength import offense_strength


def with_gap_labels(plays: DataFrame) -> DataFrame:
    """Add ``location_gap`` and ``team_location_gap``.

    A run without a location has no ``location_gap`` and the team label ``<team> NA``; a run up
    the middle has the gap ``middle``; other plays have neither.
    """
    # a branch that gives null needs no case of its own
    is_run, is_middle = F.col("play_type") == "run", F.col("run_location") == "middle"
    gap = F.when(is_middle, F.lit("middle")).when(~is_middle & is_run, paste("run_location", "run_gap"))
    return (plays.withColumn("location_gap", gap)
                 .withColumn("team_location_gap", F.when(is_run, paste("posteam", "location_gap"))))


def player_plays(plays: DataFrame, rosters: DataFrame, strength: DataFrame | None = None,
                 dedupe: bool = False) -> DataFrame:
    """Passes with a receiver and runs with a rusher, with positions and gap labels.

    A play with both a receiver and a rusher appears twice. A player listed twice in ``rosters``
    multiplies the player's plays, unless ``dedupe`` keeps one row of each. The plays are read once:
    each is exploded into its roles, and a role's joins touch only its own rows.
    """
    people = one_row_per_player(rosters) if dedupe else rosters.select("gsis_id", "position")
    small = fits_broadcast(people)
    some = plays.filter(F.col("receiver_id").isNotNull() | F.col("rusher_id").isNotNull())
    named = decode_player_ids(some)
    roles = F.array_compact(F.array(F.when(F.col("receiver_id").isNotNull(), F.lit("pass")),
                                    F.when(F.col("rusher_id").isNotNull(), F.lit("run"))))
    rows = named.withColumn("_role", F.explode(roles))
    is_pass = F.col("_role") == "pass"
    rows = rows.withColumn("_player", F.when(is_pass, F.col("receiver_id")).otherwise(F.col("rusher_id")))
    passers = people.select(F.lit("pass").alias("_role"), "gsis_id", F.col("position").alias("passer_position"))
    rows = lookup_join(rows, passers, {"_role": "_role", "passer_id": "gsis_id"}, null_safe=True, small=small)
    rows = lookup_join(rows, people.withColumnRenamed("position", "_position"), {"_player": "gsis_id"}, null_safe=True, small=small)
    both = rows.withColumns({
        "rec_position": F.when(is_pass, F.col("_position")),
        "rush_position": F.when(~is_pass, F.col("_position")),
    }).drop("_role", "_player", "_position")
    if strength is not None:
        both = lookup_join(both, settle(strength), "posteam", null_safe=True)
    return with_gap_labels(both)


def pass_model_rows(players: DataFrame) -> DataFrame:
    return players.filter(F.col("play_type") == "pass")


def run_model_rows(players: DataFrame) -> DataFrame:
    return players.filter(F.col("play_type") == "run")


PASS_MODEL_COLUMNS = (
    "posteam_type", "passer_id", "receiver_id", "shotgun", "yardline_100",
    "game_seconds_remaining", "goal_to_go", "ydstogo", "touchdown", "no_huddle", "side_of_field",
    "half_seconds_remaining", "game_half", "fumble", "rec_position", "air_yards",
    "yards_after_catch", "down", "pass_location", "run_strength", "pass_strength", "defteam",
    "qb_hit", "epa",
)

LINE_MODEL_COLUMNS = (
    "posteam_type", "rusher_id", "shotgun", "yardline_100", "game_seconds_remaining",
    "goal_to_go", "ydstogo", "touchdown", "no_huddle", "side_of_field", "half_seconds_remaining",
    "game_half", "fumble", "rush_position", "team_location_gap", "down", "epa",
)


def pass_model_sets(players: DataFrame) -> dict[str, DataFrame]:
    """Complete, incomplete and all passes with offence strength and non-null model columns."""
    passes = offense_strength(pass_model_rows(players), run_model_rows(players))
    usable = without_nulls(passes, ["epa", "down", "rec_position", "air_yards", "pass_location"])
    filled = usable.withColumn("yards_after_catch", null_fill("yards_after_catch", 0.0))
    keep = [name for name in PASS_MODEL_COLUMNS if name in filled.columns]
    return {
        "complete": filled.filter(F.col("complete_pass") == 1).select(keep),
        "incomplete": filled.filter(F.col("complete_pass") == 0).select(keep),
        "all": filled.select(keep),
    }


def line_model_rows(players: DataFrame) -> DataFrame:
    return without_nulls(run_model_rows(players).select(*LINE_MODEL_COLUMNS),
                         ["epa", "rush_position", "down"])
