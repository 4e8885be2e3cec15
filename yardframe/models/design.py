"""Design columns of a model and their cross-products.

Rows carry a factor as its value. Tasks look the values of a batch up in the level dictionary and
expand them there, so no expression has a branch per level. A factor with more than ``WIDE`` levels
can stay a distributed table; least squares then absorbs it (``models/linear.py``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yardframe.functions.nulls import without_nulls
from yardframe.operators.joins import settle

WIDE = 1000  # levels of one factor that the driver and the tasks hold


@dataclass(frozen=True)
class Numeric:
    """A number used as it is, or the result of the SQL expression ``expr`` under ``name``."""
    name: str
    expr: str | None = None

    def column(self) -> Column:
        return (F.col(self.name) if self.expr is None else F.expr(self.expr)).cast("double")


@dataclass(frozen=True)
class Factor:
    """A category with treatment coding; ``ref`` is the reference level, else the first level."""
    name: str
    ref: str | None = None

    def column(self) -> Column:
        return F.col(self.name).cast("string")


Term = Numeric | Factor


def _level_order(values: Sequence[str], ref: str | None) -> list[str]:
    try:
        ordered = sorted(values, key=float)
    except ValueError:
        ordered = sorted(values)
    if ref is not None and ref in ordered:
        ordered.remove(ref)
        ordered.insert(0, ref)
    return ordered


@dataclass(frozen=True)
class Design:
    """Terms with their levels, and the numeric columns they expand to.

    ``wide`` names the factor, if any, whose levels are not listed.
    """
    terms: tuple[Term, ...]
    levels: dict[str, list[str]]
    wide: Factor | None = None

    @staticmethod
    def learn(df: DataFrame, terms: Sequence[Term], absorb: bool = False) -> Design:
        """Find the levels of all factors in one pass over their distinct combinations.

        With ``absorb`` the factor with most levels stays out of the dictionary if it has more than WIDE.
        """
        factors = [t for t in terms if isinstance(t, Factor)]
        if not factors:
            return Design(tuple(terms), {})
        cells = df.select(*[t.column().alias(t.name) for t in factors]).distinct()
        pairs = F.explode(F.array(*[F.struct(F.lit(t.name).alias("name"), F.col(t.name).alias("level"))
                                    for t in factors]))
        found = (cells.select(pairs.alias("p")).select("p.name", "p.level").distinct()
                      .filter(F.col("level").isNotNull()))
        wide = None
        if absorb:
            known = found.limit(WIDE + 1).collect()
            if len(known) > WIDE:
                found = settle(found)
                counts = dict(found.groupBy("name").count().collect())
                most = max(factors, key=lambda t: counts.get(t.name, 0))
                wide = most if counts[most.name] > WIDE else None
                known = (found if wide is None else found.filter(F.col("name") != wide.name)).collect()
        else:
            known = found.collect()
        levels: dict[str, list[str]] = {t.name: [] for t in factors if t is not wide}
        for name, level in known:
            levels[name].append(level)
        for t in factors:
            if t is not wide:
                levels[t.name] = _level_order(levels[t.name], t.ref)
        return Design(tuple(terms), levels, wide)

    @property
    def listed(self) -> list[Term]:
        return [t for t in self.terms if self.wide is None or t.name != self.wide.name]

    def names(self) -> list[str]:
        """Design columns without the intercept."""
        return [name for columns in self.term_columns().values() for name in columns]

    def inputs(self) -> list[Column]:
        """What a task needs of a row to make its design columns."""
        return [t.column().alias(f"_t{i}") for i, t in enumerate(self.listed)]

    def expander(self) -> Callable[[pa.RecordBatch], np.ndarray]:
        """Function from a batch with the ``inputs`` to its design columns without the intercept."""
        parts = [(f"_t{i}", None if isinstance(t, Numeric) else pa.array(self.levels[t.name], pa.string()))
                 for i, t in enumerate(self.listed)]
        width = len(self.names())

        def expand(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(batch), width))
            at = 0
            for name, levels in parts:
                column = batch.column(name)
                if levels is None:
                    out[:, at] = column.to_numpy(zero_copy_only=False)
                    at += 1
                    continue
                code = pc.index_in(column, value_set=levels).to_numpy(zero_copy_only=False).astype(np.int64)
                rows = np.flatnonzero(code > 0)
                out[rows, at + code[rows] - 1] = 1.0
                at += max(len(levels) - 1, 0)
            return out
        return expand

    def columns(self) -> dict[str, Column]:
        """Name and expression of each design column, intercept first; a null input stays null."""
        made = {"(Intercept)": F.lit(1.0)}
        for term in self.listed:
            if isinstance(term, Numeric):
                made[term.name] = term.column()
                continue
            value = term.column()
            known = value.isin(self.levels[term.name])
            for level in self.levels[term.name][1:]:
                made[f"{term.name}{level}"] = F.when(
                    known, F.when(value == level, F.lit(1.0)).otherwise(F.lit(0.0)))
        return made

    def term_columns(self) -> dict[str, list[str]]:
        """Design column names by term."""
        return {t.name: [t.name] if isinstance(t, Numeric)
                else [f"{t.name}{level}" for level in self.levels[t.name][1:]]
                for t in self.listed}

    def without(self, name: str) -> Design:
        return Design(tuple(t for t in self.terms if t.name != name), self.levels, self.wide)


def complete_cases(df: DataFrame, outcome: Column, terms: Sequence[Term],
                   groups: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Rows without a null in the outcome ``_y``, any term or any group factor.

    Derived numeric terms are computed here, under the name of the term.
    """
    picked = {name: F.col(name) for name in dict.fromkeys([*groups, *keep])}
    picked.update({t.name: t.column() for t in terms})
    rows = df.select(outcome.cast("double").alias("_y"),
                     *[c.alias(name) for name, c in picked.items()])
    return without_nulls(rows, ["_y", *groups, *[t.name for t in terms]])


def plain(terms: Sequence[Term]) -> list[Term]:
    """The same terms for rows that already hold the derived columns."""
    return [Numeric(t.name) if isinstance(t, Numeric) else t for t in terms]


def cross_products(df: DataFrame, columns: dict[str, Column], by: Column | None = None,
                   reshape: Callable[[np.ndarray], np.ndarray] | None = None,
                   ) -> dict[int, np.ndarray]:
    """X'X of the named columns, whole or for each value of the small integer ``by``.

    Each task multiplies its Arrow batches; one short row per matrix entry is shuffled.
    ``reshape`` turns a batch's columns into the columns to multiply, one fewer than given.
    """
    size = len(columns) - (reshape is not None)
    group = F.lit(0) if by is None else by
    rows = df.select(group.cast("int").alias("_by"),
                     *[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    upper = np.triu_indices(size)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch["_by"].to_numpy()
            values = batch.iloc[:, 1:].to_numpy(dtype=float)
            for key in np.unique(keys):
                part = values[keys == key]
                part = part if reshape is None else reshape(part)
                sums[key] = sums.get(key, 0.0) + part.T @ part
        for key, matrix in sums.items():
            yield pd.DataFrame({"_by": np.int32(key), "i": upper[0].astype(np.int32),
                                "j": upper[1].astype(np.int32), "v": matrix[upper]})

    entries = (rows.mapInPandas(multiply, "_by int, i int, j int, v double")
                   .groupBy("_by", "i", "j").agg(F.sum("v").alias("v")).collect())
    result: dict[int, np.ndarray] = {}
    for by_value, i, j, value in entries:
        matrix = result.setdefault(by_value, np.zeros((size, size)))
        matrix[i, j] = matrix[j, i] = value
    return result


def independent(xtx: np.ndarray, tolerance: float = 1e-10) -> list[int]:
    """Positions of the columns that are no linear combination of earlier ones."""
    left = xtx.astype(float).copy()
    kept = []
    for j in range(len(left)):
        if left[j, j] > tolerance * max(xtx[j, j], 1e-300):
            kept.append(j)
            left = left - np.outer(left[:, j], left[j, :]) / left[j, j]
    return kept


def linear_predictor(columns: dict[str, Column], beta: dict[str, float]) -> Column:
    """Sum of coefficient times column; any null column makes it null."""
    total = F.lit(0.0)
    for name, value in beta.items():
        total = total + columns[name] * F.lit(float(value))
    return total
