"""Means and triangular factors of tall tables: one stable reduction behind all least-squares work.

Each task centres its Arrow batches, takes the R of their QR factorization and merges it with what
it has. Two summaries merge by stacking both R with one row for the difference of their means and
factoring again, so neither large offsets nor the number of tasks cost digits. Summaries meet in a
tree: many tasks, then a few groups, then the driver, which only sees matrices as wide as the design.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE_GROUPS = 16
ROWS_AT_ONCE = 1 << 16
TOLERANCE = 1e-11


@dataclass(frozen=True)
class Moments:
    """Row count, column means, and R with R'R = cross-products of the centred columns."""
    n: float
    means: np.ndarray
    r: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Moments:
        shift = values[0]
        moved = values - shift
        mean = moved.mean(axis=0)
        return Moments(float(len(values)), shift + mean, triangle(moved - mean))

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.means - self.means
        between = np.sqrt(self.n * other.n / n) * gap
        return Moments(n, self.means + gap * (other.n / n), triangle(np.vstack([self.r, other.r, between])))

    def norms(self) -> np.ndarray:
        """Length of each centred column."""
        return np.sqrt((self.r ** 2).sum(axis=0))

    def products(self) -> np.ndarray:
        """Cross-products of the centred columns."""
        return self.r.T @ self.r

    def take(self, columns: Sequence[int]) -> Moments:
        return Moments(self.n, self.means[list(columns)], triangle(self.r[:, list(columns)]))

    def independent(self, columns: Iterable[int], tolerance: float = TOLERANCE) -> list[int]:
        """The columns that are neither constant nor a linear combination of earlier ones.

        What is left of a column after projection is compared with its length; a column whose
        length is only rounding of its mean counts as constant.
        """
        kept: list[int] = []
        basis = np.zeros((len(self.r), 0))
        floor = 4e-16 * np.abs(self.means) * np.sqrt(max(self.n, 1.0))
        for j in columns:
            column = self.r[:, j]
            length = np.linalg.norm(column)
            rest = column - basis @ (basis.T @ column)
            rest = rest - basis @ (basis.T @ rest)
            left = np.linalg.norm(rest)
            if left > max(tolerance * length, floor[j]) and left > 0.0:
                kept.append(j)
                basis = np.column_stack([basis, rest / left])
        return kept


def triangle(values: np.ndarray) -> np.ndarray:
    """Square upper-triangular R of the values."""
    r = np.linalg.qr(values, mode="r")
    if len(r) < values.shape[1]:
        r = np.vstack([r, np.zeros((values.shape[1] - len(r), values.shape[1]))])
    return r


def merged(parts: Iterable[Moments]) -> Moments:
    return reduce(Moments.merge, parts)


def solve_centred(moments: Moments, columns: Sequence[int], outcome: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse cross-products and residual sum of squares of outcome on independent columns."""
    k = len(columns)
    if not k:
        return np.zeros(0), np.zeros((0, 0)), float(moments.norms()[outcome] ** 2)
    r = triangle(moments.r[:, [*columns, outcome]])
    inverse = np.linalg.inv(r[:k, :k])
    return inverse @ r[:k, k], inverse @ inverse.T, float(r[k, k] ** 2)


_SCHEMA = "_by int, part long, n double, means array<double>, r array<double>"


def _record(by: int, part: int, m: Moments) -> dict:
    return {"_by": by, "part": part, "n": m.n, "means": m.means.tolist(), "r": m.r.ravel().tolist()}


def _moments(row: dict) -> Moments:
    means = np.array(row["means"])
    return Moments(row["n"], means, np.array(row["r"]).reshape(len(means), len(means)))


_ARROW = pa.schema([("_by", pa.int32()), ("part", pa.int64()), ("n", pa.float64()),
                    ("means", pa.list_(pa.float64())), ("r", pa.list_(pa.float64()))])


def _batch(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(records, schema=_ARROW)


def column_moments(rows: DataFrame, expand: Callable[[pa.RecordBatch], np.ndarray],
                   by: Column | None = None) -> dict[int, Moments]:
    """Moments of the matrix that ``expand`` makes of each batch of rows, whole (key 0) or for each
    value of the small integer ``by``. An empty table gives no key."""
    keyed = rows.select(*rows.columns, (F.lit(0) if by is None else by).cast("int").alias("_by"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                keys = part.column("_by").to_numpy()
                values = expand(part)
                for key in np.unique(keys).tolist():
                    found = Moments.of(values[keys == key])
                    held[key] = held[key].merge(found) if key in held else found
        part = TaskContext.get().partitionId()
        yield _batch([_record(key, part, m) for key, m in held.items()])

    def join(table: pa.Table) -> pa.Table:
        found = sorted(table.to_pylist(), key=lambda row: row["part"])
        whole = merged(_moments(row) for row in found)
        return pa.Table.from_batches([_batch([_record(found[0]["_by"], found[0]["part"], whole)])])

    small = (keyed.mapInArrow(shrink, _SCHEMA)
                  .groupBy("_by", F.pmod("part", F.lit(TREE_GROUPS)).alias("slot")).applyInArrow(join, _SCHEMA))
    out: dict[int, list[Moments]] = {}
    for row in sorted(small.toArrow().to_pylist(), key=lambda row: row["part"]):
        out.setdefault(row["_by"], []).append(_moments(row))
    return {key: merged(parts) for key, parts in sorted(out.items())}
