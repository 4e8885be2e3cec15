"""Keys, labels and ids held as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import paste

ID_COLUMNS = ("passer_id", "receiver_id", "rusher_id")


def to_integer(c: Column) -> Column:
    """Text to whole number; text that is no number gives null."""
    return c.try_cast("int")


def season_of_game(game_id: Column) -> Column:
    return to_integer(F.substring(game_id, 1, 4))


def unite(df: DataFrame, name: str, columns: Sequence[str], sep: str = "_",
          keep: bool = True) -> DataFrame:
    """Join columns into one key; ``keep=False`` drops the parts."""
    united = df.withColumn(name, paste(*columns, sep=sep))
    return united if keep else united.drop(*columns)


def separate(df: DataFrame, name: str, into: Sequence[str], sep: str = "_") -> DataFrame:
    """Split a key into columns; missing pieces are null, extra pieces are dropped."""
    pieces = F.split(F.col(name), sep)
    return df.withColumns({part: F.get(pieces, F.lit(i)) for i, part in enumerate(into)})


def decode_id(c: Column | str) -> Column:
    """Plain form of a hex-encoded player id of 36 characters.

    Other ids stay as they are, also those whose bytes are no hex digits or no text.
    """
    value = F.col(c) if isinstance(c, str) else c
    digits = F.replace(F.substring(value, 5, 24), F.lit("-"), F.lit(""))
    plain = F.try_validate_utf8(F.unhex(digits).cast("string"))
    return F.when(F.length(value) == 36, F.coalesce(plain, value)).otherwise(value)


def decode_player_ids(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: decode_id(name) for name in present})
