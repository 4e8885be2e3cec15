"""Connected components of links and joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.llm.tables import stored

SHARE = 1024  # a key is hot with more than one row in SHARE, so at most SHARE keys are hot


def with_value_of_key(rows: DataFrame, table: DataFrame, key: str, count: str = "n") -> DataFrame:
    """rows joined with table, which has one row for each value of `key` and in `count` the number of rows that have it.

    The hot keys, SHARE at most, are broadcast; the rows of all other keys are shuffled. Where all keys are hot or none
    is, one join does it; else both inputs are read twice, so they should be stored. Null keys find nothing.
    """
    least, most, total = table.agg(F.min(count), F.max(count), F.sum(count)).first()
    if total is None or most * SHARE <= total:
        return rows.join(table.drop(count), key)
    if least * SHARE > total:
        return rows.join(F.broadcast(table.drop(count)), key)
    hot = F.col(count) * SHARE > total
    found = table.where(hot).drop(count)
    names = F.broadcast(found.select(key))
    frequent = rows.join(F.broadcast(found), key)
    others = rows.join(names, key, "left_anti").join(table.where(~hot).drop(count), key)
    return frequent.unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node that links reach), for every node of a link (a, b).

    Labels fall to the least label among the neighbours, then to that label's own label, until no neighbour has a lower
    one. A label is a reached node and none above its own node, so labels that agree with all neighbours' are the least.
    Neighbours are reduced before they are shuffled, and labels of nodes with very many links are broadcast.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    first = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"), F.count("*").alias("n"))
    labels = stored(first)
    while True:
        offered = with_value_of_key(both.withColumnRenamed("b", "node"), labels, "node")
        offered = offered.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "node").select("node", "n", "component", F.least("component", "offer").alias("next"))
        lower = stored(lower)
        if lower.where("next < component").isEmpty():
            return lower.select("node", "component")
        heads = lower.groupBy(F.col("next").alias("head")).agg(F.count("*").alias("rows"))
        heads = heads.join(lower.select(F.col("node").alias("head"), F.col("next").alias("lowest")), "head")
        jumped = with_value_of_key(lower.withColumnRenamed("next", "head"), stored(heads), "head", "rows")
        labels = stored(jumped.select("node", "n", F.col("lowest").alias("component")))
