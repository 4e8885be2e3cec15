"""Reproducible splits and folds, and cross-validated subset selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.models.design import Design, Term, complete_cases, plain
from yardframe.models.moments import Moments, column_moments, merged, solve_centred
from yardframe.operators.cutpoints import at_most, hash_cutoffs, quantiles


def row_digest(keys: Sequence[str], seed: int) -> Column:
    """Hex digest that orders rows in a fixed random-looking way."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def fold_of(keys: Sequence[str], seed: int, folds: int) -> Column:
    """Fold number from the first seven digits of the digest."""
    digits = F.conv(F.substring(row_digest(keys, seed), 1, 7), 16, 10).cast("bigint")
    return F.pmod(digits, F.lit(folds)).cast("int")


def outcome_bin(outcome: Column, cuts: Sequence[float]) -> Column:
    """Position of the quantile bin, closed on the right; the lowest value is in the first bin."""
    inner = cuts[1:-1]
    bin_ = F.lit(len(inner))
    for i in reversed(range(len(inner))):
        bin_ = F.when(outcome <= F.lit(float(inner[i])), F.lit(i)).otherwise(bin_)
    return F.when(outcome.isNotNull() & ~F.isnan(outcome.cast("double")), bin_)


def stratified_split(df: DataFrame, outcome: str, keys: Sequence[str], share: float = 0.7,
                     seed: int = 123, cut_points: int = 5) -> DataFrame:
    """Add ``in_train``: in each quantile bin of ``outcome``, the first ``share`` of the rows by digest.

    ``keys`` must identify a row. Bins and cutoffs come from counts, so no bin is ever sorted or
    held by one task. A row whose outcome is null or NaN is in no bin and so not in training.
    """
    digest = row_digest(keys, seed)
    # the searches read only these two columns, several times over
    narrow = df.select(F.col(outcome), digest.alias("_digest")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = sorted(set(quantiles(narrow, outcome, [i / (cut_points - 1) for i in range(cut_points)])))
        bin_ = outcome_bin(F.col(outcome), cuts)
        binned = narrow.select(bin_.alias("_bin"), "_digest").filter(F.col("_bin").isNotNull())
        take = {row["_bin"]: math.ceil(round(share * row["count"], 9))
                for row in binned.groupBy("_bin").count().collect()}
        cutoffs = hash_cutoffs(binned, "_bin", "_digest", take)
    finally:
        narrow.unpersist()
    return df.withColumn("in_train", F.coalesce(at_most(digest, bin_, cutoffs), F.lit(False)))


# ---------------------------------------------------------------- subset selection


def backward_path(m: Moments, outcome: int, largest: int) -> dict[int, tuple[list[int], np.ndarray]]:
    """Backward elimination of design columns: size -> (column positions, slopes).

    Each step drops the column whose removal raises the residual sum of squares least.
    """
    active = m.independent(range(outcome))
    path = {}
    while True:
        beta, inverse, _ = solve_centred(m, active, outcome)
        if len(active) <= largest:
            path[len(active)] = (list(active), beta)
        if not active:
            return path
        active.pop(int(np.argmin(beta ** 2 / np.diag(inverse))))


@dataclass(frozen=True)
class SubsetSearch:
    """Result of cross-validated backward selection."""
    results: DataFrame          # per size: RMSE, R2, MAE and their spread over folds
    fold_results: DataFrame     # per fold and size
    best_size: int
    chosen: DataFrame           # per size: the columns of the final fit on all rows
    coefficients: DataFrame     # of the best size


def cv_backward_subset(df: DataFrame, outcome: Column, terms: Sequence[Term],
                       keys: Sequence[str], sizes: Sequence[int] = range(1, 8),
                       folds: int = 10, seed: int = 123) -> SubsetSearch:
    """Cross-validated backward selection of design columns.

    One pass gives each fold's means and R; a training set merges those of the other folds, and the
    held-out squared errors follow from the fold's own. Only the absolute errors need a second pass.
    """
    spark: SparkSession = df.sparkSession
    rows = complete_cases(df, outcome, terms, keep=keys).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        design = Design.learn(rows, plain(terms))
        expand, names = design.expander(), design.names()
        width = len(names)
        ready = rows.select(*design.inputs(), "_y", fold_of(keys, seed, folds).alias("_fold"))

        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            return np.column_stack([expand(batch), batch.column("_y").to_numpy()])

        by_fold = column_moments(ready, matrix, by=F.col("_fold"))
        if not by_fold:
            raise ValueError("no complete row to fit on")
        total = merged(by_fold.values())
        sizes = [k for k in sizes if k <= len(total.independent(range(width)))]
        slopes = np.zeros((folds, width, len(sizes)))
        centre = np.zeros((folds, width + 1))
        for f in by_fold:
            others = [m for g, m in by_fold.items() if g != f]
            training = merged(others) if others else total
            centre[f] = training.means
            path = backward_path(training, width, max(sizes, default=0))
            for k, size in enumerate(sizes):
                positions, beta = path[min(size, max(path))]
                slopes[f, positions, k] = beta
        absolute = _absolute_errors(ready, matrix, centre, slopes)
    finally:
        rows.unpersist()
    fold_rows = []
    for f, held in sorted(by_fold.items()):
        offset = held.means - centre[f]
        for k, size in enumerate(sizes):
            b = slopes[f, :, k]
            fitted, seen = held.r[:, :-1] @ b, held.r[:, -1]
            bias = offset[-1] - offset[:-1] @ b
            mse = bias ** 2 + ((seen - fitted) ** 2).sum() / held.n
            spread = (fitted @ fitted) * (seen @ seen)
            r2 = (fitted @ seen) ** 2 / spread if spread > 0 else math.nan
            fold_rows.append((int(f), int(size), float(math.sqrt(mse)), float(r2),
                              float(absolute[f][k] / held.n), int(round(held.n))))
    frame = pd.DataFrame(fold_rows, columns=["fold", "nvmax", "rmse", "r2", "mae", "n"])
    grouped = frame.groupby("nvmax")[["rmse", "r2", "mae"]]
    means, spreads = grouped.mean(), grouped.std()
    results = [(int(k), *map(float, means.loc[k]), *map(float, spreads.loc[k])) for k in means.index]
    final = backward_path(total, width, max(sizes, default=0))
    best = int(means["rmse"].idxmin()) if len(means) else 0
    chosen = [(int(size), names[i], i in set(final[size][0])) for size in sizes for i in range(width)]
    positions, beta = final[best]
    start = float(total.means[-1] - total.means[positions] @ beta)
    return SubsetSearch(
        spark.createDataFrame(results, "nvmax int, rmse double, r2 double, mae double, "
                                       "rmse_sd double, r2_sd double, mae_sd double"),
        spark.createDataFrame(fold_rows, "fold int, nvmax int, rmse double, r2 double, mae double, n bigint"),
        best,
        spark.createDataFrame(chosen, "nvmax int, term string, included boolean"),
        spark.createDataFrame([("(Intercept)", start), *[(names[i], float(b)) for i, b in zip(positions, beta)]],
                              "term string, estimate double"))


def _absolute_errors(ready: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray],
                     centre: np.ndarray, slopes: np.ndarray) -> dict[int, list[float]]:
    """Sum of absolute held-out errors by fold, one value per subset size."""
    sizes = slopes.shape[2]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(slopes), sizes))
        for batch in batches:
            keys, values = batch.column("_fold").to_numpy(), matrix(batch)
            for f in np.unique(keys):
                part = values[keys == f] - centre[f]
                sums[f] += np.abs(part[:, -1:] - part[:, :-1] @ slopes[f]).sum(axis=0)
        f, k = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(f.ravel(), pa.int32()), pa.array(k.ravel(), pa.int32()), pa.array(sums.ravel())],
                                         ["fold", "k", "v"])

    scored = (ready.mapInArrow(score, "fold int, k int, v double")
                   .groupBy("fold", "k").agg(F.sum("v").alias("v")).collect())
    result: dict[int, list[float]] = {f: [0.0] * sizes for f in range(len(slopes))}
    for f, k, v in scored:
        result[f][k] = v
    return result
