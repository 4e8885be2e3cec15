"""Left joins of detail rows onto dimensions and aggregates.

A side is broadcast only after its rows are counted. A larger side is joined by shuffle on the key
plus a salt, so that a key that holds a large share of the detail rows spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.session import ensure_checkpoint_dir

BROADCAST_CELLS = 4_000_000
SALTS = 32


def settle(df: DataFrame) -> DataFrame:
    """Compute an aggregate once and keep it in the shared checkpoint folder.

    Later stages, counts and retries after a lost executor read the stored rows instead of
    scanning the detail rows again.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(side: DataFrame, cells: int | None = None) -> bool:
    """Whether the counted rows times columns stay within the broadcast bound."""
    limit = BROADCAST_CELLS if cells is None else cells
    return side.count() * len(side.columns) <= limit


def _pairs(on: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    return [(name, name) for name in on]


def lookup_join(detail: DataFrame, side: DataFrame, on: str | Sequence[str] | Mapping[str, str],
                null_safe: bool = False, salt_on: Sequence[str] = (),
                cells: int | None = None, small: bool | None = None) -> DataFrame:
    """Left join that adds the non-key columns of ``side`` to ``detail``.

    ``on`` names the keys, as a mapping where the two sides differ. ``null_safe`` lets a null key
    match a null key. Duplicate keys in ``side`` multiply the detail rows. ``small`` passes on the
    result of an earlier ``fits_broadcast`` for the same side.
    """
    pairs = _pairs(on)
    keys = {f"_key{i}": right for i, (_, right) in enumerate(pairs)}
    right_names = set(keys.values())
    side = side.select(
        *[F.col(right).alias(name) for name, right in keys.items()],
        *[F.col(name) for name in side.columns if name not in right_names],
    )
    if fits_broadcast(side, cells) if small is None else small:
        return _joined(detail, F.broadcast(side), pairs, list(keys), null_safe)
    spread = list(salt_on) or [name for name in ("game_id", "play_id") if name in detail.columns] \
        or detail.columns
    salted = detail.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)))
    copies = side.withColumn("_salt_side", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                F.lit(SALTS - 1).cast("bigint"))))
    joined = _joined(salted, copies, [*pairs, ("_salt", "_salt")], [*keys, "_salt_side"], null_safe)
    return joined.drop("_salt")


def _joined(detail: DataFrame, side: DataFrame, pairs: Sequence[tuple[str, str]],
            key_names: Sequence[str], null_safe: bool) -> DataFrame:
    condition = None
    for (left, _), name in zip(pairs, key_names):
        test = F.col(left).eqNullSafe(F.col(name)) if null_safe else F.col(left) == F.col(name)
        condition = test if condition is None else condition & test
    return detail.join(side, condition, "left").drop(*key_names)


def natural_left_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Left join on all columns that both sides share."""
    shared = [name for name in left.columns if name in set(right.columns)]
    if not shared:
        raise ValueError("the two sides share no column")
    return lookup_join(left, right, shared, null_safe=null_safe)


def suffixed_left_join(left: DataFrame, right: DataFrame, on: Sequence[str],
                       suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join where columns that occur on both sides get a suffix."""
    clash = [name for name in left.columns if name in set(right.columns) and name not in on]
    return lookup_join(
        left.withColumnsRenamed({name: name + suffixes[0] for name in clash}),
        right.withColumnsRenamed({name: name + suffixes[1] for name in clash}),
        list(on), null_safe=True,
    )


def role_join(detail: DataFrame, rosters: DataFrame, roles: Mapping[str, str],
              small: bool | None = None, dedupe: bool = False) -> DataFrame:
    """Join one roster several times: ``roles`` maps a player-id column to the new column.

    The roster is cut to its id and position, so that each role adds one column, and counted once.
    A player listed twice multiplies the detail rows; ``dedupe`` keeps one row of each player, the
    one of the earliest season and then the least position.
    """
    people = one_row_per_player(rosters) if dedupe else rosters.select("gsis_id", "position")
    small = fits_broadcast(people) if small is None else small
    for id_column, position_column in roles.items():
        detail = lookup_join(detail, people.withColumnRenamed("position", position_column),
                             {id_column: "gsis_id"}, null_safe=True, small=small)
    return detail


def one_row_per_player(rosters: DataFrame) -> DataFrame:
    """gsis_id and position of each player's earliest season, the least position where it has several."""
    order = [c for c in ("season",) if c in rosters.columns]
    rank = F.struct(*[F.col(c) for c in order], F.col("position").isNull().alias("no_position"), F.col("position").alias("least"))
    return settle(rosters.groupBy("gsis_id").agg(F.min_by("position", rank).alias("position")))
