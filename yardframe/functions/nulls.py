"""Null rules: conditionals keep nulls, text joins write ``NA``, strict means refuse nulls.

Two families of sums and means exist. The plain ones skip nulls, as SQL does. The strict ones
return null as soon as one input row of the group is null.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_count() -> Column:
    return F.count(F.lit(1))


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every listed column; NaN is no value.

    One test per column lets each be pushed to its own side of a join. ``dropna`` makes a single
    test over all columns, whose rewritings grow exponentially in the optimizer.
    """
    floating = {name for name, kind in df.dtypes if kind in ("double", "float")}

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter(F.col(name).isNotNull())
        return rows.filter(~F.isnan(name)) if name in floating else rows

    return reduce(kept, dict.fromkeys(columns), df)


def if_else(test: Column, yes: Column, no: Column) -> Column:
    """Null test gives null, unlike ``when(...).otherwise(...)``."""
    return F.when(test, yes).when(~test, no)


def na_text(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("NA"))


def paste(*cols: Column | str, sep: str = " ") -> Column:
    """Join values as text; a null is written as ``NA``."""
    return F.concat_ws(sep, *[na_text(c) for c in cols])


def null_fill(c: Column | str, value) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def _strict(total: Column, value: Column) -> Column:
    return F.when(row_count() == F.count(value), total)


def strict_sum(c: Column | str) -> Column:
    value = _col(c)
    return _strict(F.sum(value), value)


def strict_mean(c: Column | str) -> Column:
    value = _col(c)
    return _strict(F.avg(value), value)


def sum_where(c: Column | str, test: Column) -> Column:
    return F.sum(F.when(test, _col(c)))


def strict_mean_where(c: Column | str, test: Column) -> Column:
    """Mean over the rows that pass ``test``; null when one of those rows is null."""
    value = F.when(test, _col(c))
    return F.when(F.count(F.when(test, F.lit(1))) == F.count(value), F.avg(value))


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives null for a zero divisor."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    return ratio(F.sum(_col(value) * _col(weight)), F.sum(weight))


def threshold_flag(c: Column | str, limit) -> Column:
    test = _col(c) > F.lit(limit)
    return if_else(test, F.lit(1), F.lit(0))
