"""First row per key, ranks within a season and sorted results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from yardframe.operators.joins import lookup_join, settle


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole first row of each key, by ascending ``order`` with nulls last.

    This is an aggregate with a partial step, so a key with many rows is reduced before the
    shuffle. End ``order`` with a unique column to make the choice definite.
    """
    rank = F.struct(*[part for i, c in enumerate(order)
                      for part in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))])
    row = F.min_by(F.struct(*df.columns), rank).alias("row")
    return df.groupBy(*keys).agg(row).select("row.*")


def dense_rank_within(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Descending dense rank of ``value`` in each group; a null value has no rank.

    The distinct values are dealt by range, so no task holds a group. Each range is ranked by
    itself, and the number of values in the group's earlier ranges is added to its ranks.
    """
    order = F.desc_nulls_last(value)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = settle(df.select(group, value).distinct().repartitionByRange(parts, F.col(group), order)
                      .withColumn("_part", F.spark_partition_id()))
    counts = values.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    own = values.withColumn("_own", F.dense_rank().over(W.partitionBy(group, "_part").orderBy(order)))
    ranked = lookup_join(own, settle(starts), [group, "_part"], null_safe=True, salt_on=[value])
    rank = (F.col("_own") + F.col("_before")).cast("int")
    ranks = ranked.select(group, value, F.when(F.col(value).isNotNull(), rank).alias(name))
    return lookup_join(df, settle(ranks), [group, value], null_safe=True, salt_on=df.columns)


def sort_desc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    """Largest first, nulls last; ``ties`` split equal values over the sort's partitions."""
    return df.orderBy(F.desc_nulls_last(column), *[F.asc_nulls_last(t) for t in ties])


def sort_asc(df: DataFrame, column: str, *ties: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), *[F.asc_nulls_last(t) for t in ties])


def pivot_mean(df: DataFrame, key: str, column: str, value: str,
               names: dict[str, str]) -> DataFrame:
    """Mean of ``value`` by ``key``, one column per listed level of ``column``."""
    wide = (df.filter(F.col(column).isin(list(names)))
              .groupBy(key).pivot(column, list(names)).agg(F.avg(value)))
    return wide.withColumnsRenamed(names)
