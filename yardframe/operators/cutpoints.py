"""Exact order statistics over data that no single task could sort.

Both searches narrow down by counting: each round is one aggregate with a small, bounded result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024
DIGITS = 3


def _values(df: DataFrame, column: str) -> tuple[DataFrame, float, float, int]:
    """The values with their smallest, largest and count; NaN counts as null, as it equals nothing."""
    data = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return data, *data.agg(F.min("v"), F.max("v"), F.count("v")).first()


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int]) -> dict[int, float]:
    """The values at the given zero-based ranks of the non-null values of ``column``."""
    data, low, high, total = _values(df, column)
    if any(not 0 <= rank < total for rank in ranks):
        raise ValueError("rank outside the data")
    return _at_ranks(data, low, high, ranks)


def _at_ranks(data: DataFrame, low: float, high: float, ranks: Sequence[int]) -> dict[int, float]:
    found: dict[int, float] = {}
    # each open span: (low, high, rows below it) -> the ranks that fall in it
    open_spans = {(low, high, 0): sorted(set(ranks))}
    while open_spans:
        spans = list(open_spans.items())
        if all(lo == hi for (lo, hi, _), _ in spans):
            for (lo, _, _), wanted in spans:
                found.update({rank: lo for rank in wanted})
            break
        number, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, ((lo, hi, _), _) in enumerate(spans):
            inside = F.col("v").between(lo, hi)
            width = (hi - lo) or 1.0
            slot = F.least(F.floor((F.col("v") - lo) / F.lit(width) * BINS), F.lit(BINS - 1)).cast("int")
            number = F.when(inside, F.lit(i)).otherwise(number)
            bin_ = F.when(inside, slot).otherwise(bin_)
        counts = (data.select("v", number.alias("span"), bin_.alias("bin"))
                      .filter(F.col("span").isNotNull())
                      .groupBy("span", "bin")
                      .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
                      .orderBy("span", "bin").collect())
        open_spans = {}
        for i, ((_, _, below), wanted) in enumerate(spans):
            for row in (r for r in counts if r["span"] == i):
                inside = [rank for rank in wanted if below <= rank < below + row["n"]]
                if inside and row["lo"] == row["hi"]:
                    found.update({rank: row["lo"] for rank in inside})
                elif inside:
                    open_spans[(row["lo"], row["hi"], below)] = inside
                below += row["n"]
    return found


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbouring order statistics."""
    data, low, high, total = _values(df, column)
    if not total:
        raise ValueError(f"{column} has no value")
    places = [share * (total - 1) for share in shares]
    ranks = sorted({rank for place in places for rank in (math.floor(place), math.ceil(place))})
    values = _at_ranks(data, low, high, ranks)
    result = []
    for place in places:
        lower, upper = values[math.floor(place)], values[math.ceil(place)]
        result.append(lower + (upper - lower) * (place - math.floor(place)))
    return result


def hash_cutoffs(df: DataFrame, group: str, digest: str, take: Mapping[int, int]) -> dict[int, str]:
    """For each group, the ``take``-th smallest digest (hex text, unique in the group).

    Rows with a digest up to the cutoff are exactly the ``take`` first rows by digest.
    """
    cutoffs: dict[int, str] = {}
    wanted = {g: ("", k) for g, k in take.items() if k > 0}
    while wanted:
        length = max(len(prefix) for prefix, _ in wanted.values())
        step = length + DIGITS
        held = F.lit(False)
        for g, (prefix, _) in wanted.items():
            held = held | ((F.col(group) == g) & F.col(digest).startswith(prefix))
        counts = (df.filter(held)
                    .groupBy(group, F.substring(digest, 1, step).alias("prefix"))
                    .agg(F.count(F.lit(1)).alias("n"), F.min(digest).alias("only"))
                    .orderBy(group, "prefix").collect())
        following = {}
        for g, (_, k) in wanted.items():
            for row in (r for r in counts if r[group] == g):
                if k <= row["n"]:
                    if row["n"] == 1 or len(row["prefix"]) < step:
                        cutoffs[g] = row["only"]
                    else:
                        following[g] = (row["prefix"], k)
                    break
                k -= row["n"]
        wanted = following
    return cutoffs


def at_most(digest: Column, group: Column, cutoffs: Mapping[int, str]) -> Column:
    """True for rows whose digest does not pass their group's cutoff."""
    kept = F.lit(False)
    for g, cutoff in cutoffs.items():
        kept = kept | ((group == g) & (digest <= cutoff))
    return kept
