"""Schemas of the three input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXT, _INT, _LONG, _REAL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _table(required: dict, optional: dict) -> T.StructType:
    return T.StructType(
        [T.StructField(name, kind, False) for name, kind in required.items()]
        + [T.StructField(name, kind, True) for name, kind in optional.items()]
    )


PLAYS = _table(
    {"game_id": _TEXT, "play_id": _LONG, "season": _INT, "season_type": _TEXT,
     "home_team": _TEXT, "away_team": _TEXT},
    {"posteam": _TEXT, "defteam": _TEXT, "posteam_type": _TEXT, "side_of_field": _TEXT,
     "play_type": _TEXT,
     "passer_id": _TEXT, "receiver_id": _TEXT, "rusher_id": _TEXT,
     "passer": _TEXT, "receiver": _TEXT, "rusher": _TEXT, "receiver_player_name": _TEXT,
     "run_location": _TEXT, "run_gap": _TEXT, "pass_location": _TEXT,
     "down": _INT, "ydstogo": _INT, "yardline_100": _INT,
     "shotgun": _INT, "no_huddle": _INT, "goal_to_go": _INT, "qb_hit": _INT,
     "qb_scramble": _INT, "sack": _INT, "interception": _INT, "touchdown": _INT, "fumble": _INT,
     "game_seconds_remaining": _INT, "half_seconds_remaining": _INT, "game_half": _TEXT,
     "score_differential": _INT, "roof": _TEXT, "surface": _TEXT, "temp": _INT, "wind": _INT,
     "pass_attempt": _INT, "complete_pass": _INT, "incomplete_pass": _INT,
     "third_down_converted": _INT,
     "air_yards": _REAL, "yards_after_catch": _REAL, "yards_gained": _REAL,
     "epa": _REAL, "wp": _REAL, "wpa": _REAL},
)

ROSTERS = _table(
    {"season": _INT},
    {"team": _TEXT, "gsis_id": _TEXT, "full_name": _TEXT, "position": _TEXT,
     "height": _INT, "weight": _INT},
)

TEAMS = _table({"team_abbr": _TEXT}, {"team_color": _TEXT})


def check(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Return ``df`` when it has every column of ``schema`` with the same type, else raise."""
    found = {field.name: field.dataType for field in df.schema}
    wrong = [
        f"{field.name}: expected {field.dataType.simpleString()}, "
        f"found {found[field.name].simpleString() if field.name in found else 'nothing'}"
        for field in schema
        if found.get(field.name) != field.dataType
    ]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
