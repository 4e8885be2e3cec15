"""Least squares and logistic regression, with diagnostics."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.models.design import (
    Design, Factor, Numeric, Term, complete_cases, plain,
)
from yardframe.models.distributions import chi2_tail, f_tail, t_two_sided
from yardframe.models.moments import Moments, column_moments, solve_centred
from yardframe.operators.joins import fits_broadcast, lookup_join, settle


@dataclass(frozen=True)
class Absorbed:
    """A factor that least squares eliminates: row count, outcome mean and column means of each level."""
    factor: Factor
    levels: DataFrame                      # level, n, mean_y, means
    count: int
    ref: str


@dataclass(frozen=True)
class LinearFit:
    """A least-squares fit and what its tables need.

    The solution is held for centred columns: ``means`` of the kept columns, ``mean_y`` and
    ``inner``, the inverse of the centred cross-products. ``beta`` and ``xtx_inverse`` are those of
    the columns as given. With an absorbed factor they lack the intercept and that factor's columns,
    which ``summary`` takes from the level table.
    """
    design: Design
    names: list[str]
    dropped: list[str]
    beta: np.ndarray
    xtx_inverse: np.ndarray
    rows: int
    rss: float
    tss: float
    means: np.ndarray
    mean_y: float
    inner: np.ndarray
    absorbed: Absorbed | None = field(default=None, repr=False)

    @property
    def parameters(self) -> int:
        return len(self.names) + (self.absorbed.count if self.absorbed else 0)

    @property
    def df_residual(self) -> int:
        return self.rows - self.parameters

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_residual

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss

    @property
    def slopes(self) -> dict[str, float]:
        """Coefficients by column, without the intercept."""
        return {name: float(b) for name, b in zip(self.names, self.beta) if name != "(Intercept)"}

    def covariance(self) -> np.ndarray:
        return self.sigma2 * self.xtx_inverse

    def summary(self, spark: SparkSession, covariance: np.ndarray | None = None) -> DataFrame:
        """Coefficient table; another covariance gives robust tests."""
        errors = np.sqrt(np.diag(self.covariance() if covariance is None else covariance))
        rows = []
        for name, value, error in zip(self.names, self.beta, errors):
            t = value / error if error > 0 else math.nan
            rows.append((name, float(value), float(error), float(t), t_two_sided(t, self.df_residual)))
        rows += [(name, None, None, None, None) for name in self.dropped]
        table = spark.createDataFrame(rows, _SUMMARY)
        return table if self.absorbed is None else _level_summary(self).unionByName(table)

    def fit_statistics(self, spark: SparkSession) -> DataFrame:
        p = self.parameters - 1
        f = ((self.tss - self.rss) / p) / self.sigma2 if p else math.nan
        adjusted = 1.0 - (1.0 - self.r2) * (self.rows - 1) / self.df_residual
        return spark.createDataFrame(
            [(self.rows, self.df_residual, math.sqrt(self.sigma2), self.r2, adjusted, float(f),
              f_tail(f, p, self.df_residual))],
            "n bigint, df_residual bigint, sigma double, r2 double, adj_r2 double, "
            "f_value double, p_value double")


_SUMMARY = "term string, estimate double, std_error double, t_value double, p_value double"


def _dot(values: Column, weights: Sequence[float]) -> Column:
    pairs = F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w)
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def _level_summary(fit: LinearFit) -> DataFrame:
    """Intercept (the reference level) and the absorbed factor's columns, one row a level."""
    absorbed, df = fit.absorbed, fit.df_residual
    first = absorbed.levels.filter(F.col("level") == absorbed.ref).first()
    base = first["mean_y"] - float(np.dot(fit.beta, first["means"]))
    is_ref = F.col("level") == absorbed.ref
    own = F.col("mean_y") - _dot(F.col("means"), fit.beta)
    # var(level) = s2 (1/n + m C m'), of a difference s2 (1/n + 1/n0 + (m - m0) C (m - m0)')
    gap = F.when(is_ref, F.col("means")).otherwise(
        F.zip_with("means", F.array(*[F.lit(float(v)) for v in first["means"]]), lambda a, b: a - b))
    form = F.lit(0.0)
    for i, row in enumerate(fit.inner):
        form = form + F.element_at(gap, i + 1) * _dot(gap, row)
    variance = F.lit(fit.sigma2) * (1.0 / F.col("n") + F.when(is_ref, 0.0).otherwise(1.0 / first["n"]) + form)
    table = absorbed.levels.select(
        F.when(is_ref, "(Intercept)").otherwise(F.concat(F.lit(absorbed.factor.name), "level")).alias("term"),
        F.when(is_ref, own).otherwise(own - F.lit(base)).alias("estimate"), F.sqrt(variance).alias("std_error"))
    table = table.withColumn("t_value", F.col("estimate") / F.col("std_error"))

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(p_value=[t_two_sided(t, df) for t in frame["t_value"]])
    return table.mapInPandas(tails, _SUMMARY)


def fit_linear(df: DataFrame, outcome: Column, terms: Sequence[Term]) -> LinearFit:
    """Ordinary least squares over the complete rows, in one pass after the level dictionary.

    Columns that repeat earlier ones are dropped before the solve and listed in ``dropped``. One
    factor may have any number of levels: past ``WIDE`` it is absorbed, which takes a pass for the
    means of its levels and gives the same estimates.
    """
    rows = complete_cases(df, outcome, terms)
    design = Design.learn(rows, plain(terms), absorb=True)
    fit = _fit_rows(rows, design)
    return _with_design(fit, Design(tuple(terms), design.levels, design.wide))


def _with_design(fit: LinearFit, design: Design) -> LinearFit:
    return LinearFit(design, fit.names, fit.dropped, fit.beta, fit.xtx_inverse, fit.rows, fit.rss, fit.tss,
                     fit.means, fit.mean_y, fit.inner, fit.absorbed)


def _whole(found: dict[int, Moments]) -> Moments:
    if 0 not in found:
        raise ValueError("no complete row to fit on")
    return found[0]


def _fit_rows(rows: DataFrame, design: Design) -> LinearFit:
    """Fit of ``_y`` on rows whose derived terms are already computed."""
    if design.wide is not None:
        return _fit_absorbed(rows, design)
    expand = design.expander()
    names = design.names()

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([expand(batch), batch.column("_y").to_numpy()])

    m = _whole(column_moments(rows.select(*design.inputs(), "_y"), matrix))
    kept = m.independent(range(len(names)))
    slopes, inner, rss = solve_centred(m, kept, len(names))
    means, mean_y, n = m.means[kept], float(m.means[-1]), int(round(m.n))
    centred = np.zeros((len(kept) + 1, len(kept) + 1))
    centred[0, 0] = 1.0 / n
    centred[1:, 1:] = inner
    back = _from_centred(means)
    return LinearFit(
        design, ["(Intercept)", *[names[i] for i in kept]],
        [name for i, name in enumerate(names) if i not in set(kept)],
        np.concatenate([[mean_y - means @ slopes], slopes]), back @ centred @ back.T,
        n, rss, float(m.norms()[-1] ** 2), means, mean_y, inner)


def _from_centred(means: np.ndarray) -> np.ndarray:
    """Coefficients of the columns as given from those of the centred columns."""
    back = np.eye(len(means) + 1)
    back[0, 1:] = -means
    return back


def _level_means(rows: DataFrame, design: Design) -> DataFrame:
    """Row count, outcome mean and means of all design columns by level of the wide factor."""
    columns = list(design.columns().values())[1:]
    keyed = rows.select(design.wide.column().alias("level"), "_y", *[c.alias(f"c{i}") for i, c in enumerate(columns)])
    means = [F.avg(f"c{i}") for i in range(len(columns))]
    return settle(keyed.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean_y"),
        (F.array(*means) if means else F.array().cast("array<double>")).alias("means")))


def _within(rows: DataFrame, design: Design, levels: DataFrame) -> DataFrame:
    """The rows with the count and means of their level."""
    # fixed names: the level's columns start with an underscore, as no term does
    side = levels.select("level", F.col("n").alias("_n"), F.col("mean_y").alias("_mean_y"), F.col("means").alias("_means"))
    keyed = rows.select("_y", *design.inputs(), design.wide.column().alias("_level"))
    return lookup_join(keyed, side, {"_level": "level"}, small=fits_broadcast(levels), salt_on=["_y"])


def _deviations(batch: pa.RecordBatch, values: np.ndarray) -> np.ndarray:
    """Design columns and outcome less the means of the row's level."""
    means = batch.column("_means").flatten().to_numpy().reshape(values.shape)
    y = batch.column("_y").to_numpy() - batch.column("_mean_y").to_numpy()
    return np.column_stack([values - means, y])


def _fit_absorbed(rows: DataFrame, design: Design) -> LinearFit:
    """Least squares on deviations from the level means of the wide factor."""
    expand, names = design.expander(), design.names()
    levels = _level_means(rows, design)
    m = _whole(column_moments(_within(rows, design, levels), lambda batch: _deviations(batch, expand(batch))))
    kept = m.independent(range(len(names)))
    slopes, inner, rss = solve_centred(m, kept, len(names))
    some = levels.withColumn("means", F.array(*[F.element_at("means", i + 1) for i in kept]) if kept
                             else F.array().cast("array<double>"))
    total = levels.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("levels"), F.min("level").alias("least"),
                       (F.sum(F.col("n") * F.col("mean_y")) / F.sum("n")).alias("mean")).first()
    between = levels.agg(F.sum(F.col("n") * F.pow(F.col("mean_y") - F.lit(total["mean"]), 2)).alias("b")).first()["b"]
    wanted = design.wide.ref
    ref = wanted if wanted is not None and not levels.filter(F.col("level") == wanted).isEmpty() else total["least"]
    used = [names[i] for i in kept]
    return LinearFit(
        design, used, [name for name in names if name not in set(used)], slopes, inner, int(total["n"]), rss,
        float(m.norms()[-1] ** 2 + between), np.zeros(len(kept)), 0.0, inner,
        Absorbed(design.wide, some, total["levels"], ref))


# ---------------------------------------------------------------- scores


def factor_effects(design: Design, slopes: dict[str, float], spark: SparkSession) -> dict[str, DataFrame]:
    """level, effect of each listed factor that has a coefficient."""
    out = {}
    for t in design.listed:
        if isinstance(t, Factor):
            rows = [(level, slopes.get(f"{t.name}{level}", 0.0) if i else 0.0) for i, level in enumerate(design.levels[t.name])]
            out[t.name] = spark.createDataFrame(rows, "level string, effect double")
    return out


def linear_score(df: DataFrame, design: Design, slopes: dict[str, float], centre: dict[str, float],
                 constant: float, name: str) -> DataFrame:
    """Add the sum of constant, slope times centred number, and the effect of each factor's level.

    A null or an unseen level gives null. Levels are joined, so no expression grows with them.
    """
    total = F.lit(float(constant))
    effects = factor_effects(design, slopes, df.sparkSession)
    for i, t in enumerate(design.listed):
        if isinstance(t, Numeric):
            total = total + (t.column() - F.lit(centre.get(t.name, 0.0))) * F.lit(slopes.get(t.name, 0.0))
            continue
        side = effects[t.name].withColumnRenamed("effect", f"_effect{i}")
        df = lookup_join(df.withColumn(f"_value{i}", t.column()), side, {f"_value{i}": "level"}, small=True).drop(f"_value{i}")
        total = total + F.col(f"_effect{i}")
    used = [c for c in df.columns if c.startswith("_effect")]
    return df.withColumn(name, total).drop(*used)


def predict(df: DataFrame, fit: LinearFit, name: str, less_mean: bool = False) -> DataFrame:
    """Add the prediction; a row with a null or an unseen level gets null.

    ``less_mean`` leaves out the mean of the outcome, which residuals of large outcomes need.
    """
    centre = dict(zip([n for n in fit.names if n != "(Intercept)"], fit.means))
    numeric = {t.name for t in fit.design.terms if isinstance(t, Numeric)}
    constant = 0.0 if less_mean else fit.mean_y
    constant -= sum(b * centre[n] for n, b in fit.slopes.items() if n not in numeric)
    centre = {n: v for n, v in centre.items() if n in numeric}
    scored = linear_score(df, fit.design, fit.slopes, centre, constant, name)
    if fit.absorbed is None:
        return scored
    own = fit.absorbed.levels.select("level", (F.col("mean_y") - _dot(F.col("means"), fit.beta)).alias("_own"))
    keyed = scored.withColumn("_value", fit.absorbed.factor.column())
    joined = lookup_join(keyed, own, {"_value": "level"}, small=fits_broadcast(own), salt_on=df.columns)
    return joined.withColumn(name, F.col(name) + F.col("_own")).drop("_value", "_own")


def rmse(df: DataFrame, predicted: str, observed: str) -> DataFrame:
    gap = F.col(predicted) - F.col(observed)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"))


def breusch_pagan(df: DataFrame, outcome: Column, fit: LinearFit) -> dict[str, float]:
    """Studentized test: squared residuals regressed on the same design, LM = n R^2."""
    rows = complete_cases(df, outcome, fit.design.terms)
    inner = _with_design(fit, Design(tuple(plain(fit.design.terms)), fit.design.levels, fit.design.wide))
    gap = (F.col("_y") - F.lit(fit.mean_y)) - F.col("_fitted")
    squares = predict(rows, inner, "_fitted", less_mean=True).withColumn("_y", gap * gap).drop("_fitted")
    aux = _fit_rows(squares, inner.design)
    statistic = fit.rows * aux.r2
    degrees = fit.parameters - 1
    return {"statistic": float(statistic), "df": degrees, "p_value": chi2_tail(statistic, degrees)}


def robust_covariance(df: DataFrame, outcome: Column, fit: LinearFit) -> np.ndarray:
    """HC3 covariance in the columns of ``fit.beta``: leverages row by row, then one weighted reduction."""
    design = Design(tuple(plain(fit.design.terms)), fit.design.levels, fit.design.wide)
    rows = complete_cases(df, outcome, fit.design.terms)
    expand, names = design.expander(), design.names()
    places = [names.index(n) for n in fit.slopes]
    means, mean_y, inner, n = fit.means, fit.mean_y, fit.inner, fit.rows
    slopes = np.array(list(fit.slopes.values()))
    wide = fit.absorbed is not None

    def scaled(batch: pa.RecordBatch) -> np.ndarray:
        if wide:
            levels = batch.column("_means").flatten().to_numpy().reshape(len(batch), len(places))
            x = expand(batch)[:, places] - levels
            y = batch.column("_y").to_numpy() - batch.column("_mean_y").to_numpy()
            base = 1.0 / batch.column("_n").to_numpy()
        else:
            x = expand(batch)[:, places] - means
            y = batch.column("_y").to_numpy() - mean_y
            base = np.full(len(batch), 1.0 / n)
        leverage = base + np.einsum("ij,ij->i", x @ inner, x)
        weight = (y - x @ slopes) / (1.0 - leverage)
        return (x if wide else np.column_stack([np.ones(len(x)), x])) * weight[:, None]

    used = _within(rows, design, fit.absorbed.levels) if wide else rows.select(*design.inputs(), "_y")
    m = _whole(column_moments(used, scaled))
    meat = m.products() + m.n * np.outer(m.means, m.means)
    if wide:
        return inner @ meat @ inner
    centred = np.zeros_like(meat)
    centred[0, 0] = 1.0 / n
    centred[1:, 1:] = inner
    back = _from_centred(means)
    return back @ centred @ meat @ centred @ back.T


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and the parts of its confidence band at a point.

    The half width of the band at x0 is t * sigma * sqrt(1/n + (x0 - mean_x)^2 / sxx).
    """
    return df.agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"), F.regr_avgx(y, x).alias("mean_x"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"),
    ).select(
        "slope", "intercept", "n", "mean_x", "sxx",
        F.sqrt((F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)).alias("sigma"))


@dataclass(frozen=True)
class LogisticFit:
    """A logistic fit: coefficients by design column.

    ``separated``: some combination of columns tells the outcomes of some rows apart without error,
    so no finite estimate exists and the coefficients are those of the last round.
    """
    design: Design
    beta: dict[str, float]
    errors: dict[str, float]
    dropped: list[str]
    converged: bool
    separated: bool
    rounds: int

    def coefficients(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(name, float(value), float(self.errors[name]), self.converged, self.separated)
             for name, value in self.beta.items()],
            "term string, estimate double, std_error double, converged boolean, separated boolean")


ROUNDS = 50
_STEEP = 15.0  # log-odds past which a fit that still moves may be separated
_STILL, _GROWN = 1e-6, 0.1  # change of log-odds that counts as none, and as growth


def _raw(m: Moments) -> np.ndarray:
    """R of the columns as reduced, from R of the centred ones."""
    return np.vstack([m.r, np.sqrt(m.n) * m.means])


def _least_squares(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the last column on the others, and the inverse of their R."""
    r = np.linalg.qr(r, mode="r")
    k = r.shape[1] - 1
    inverse = np.linalg.inv(r[:k, :k])
    return inverse @ r[:k, k], inverse


def fit_logistic(df: DataFrame, outcome: Column, terms: Sequence[Term]) -> LogisticFit:
    """Binomial regression with the logit link over the complete rows.

    Rows are reduced once to cells, one for each combination of the terms' values; every round of
    reweighted least squares reads the cells only. Where the log-odds grow without settling, the
    step just taken is tested for being a direction of separation, in the pass that is due anyway.
    """
    rows = complete_cases(df, outcome, terms)
    design = Design.learn(rows, plain(terms))
    inputs = [f"_t{i}" for i in range(len(design.listed))]
    cells = settle(rows.select(*design.inputs(), "_y").groupBy(*inputs).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_hits")))
    expand, names = design.expander(), design.names()
    m = column_moments(cells, expand)
    if 0 not in m:
        raise ValueError("no complete row to fit on")
    kept = m[0].independent(range(len(names)))
    means = m[0].means[kept]

    def solve(weigh) -> tuple[np.ndarray, np.ndarray, Moments]:
        """One weighted least-squares pass; ``weigh`` gives root weights and targets of a batch."""
        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            x = np.column_stack([np.ones(len(batch)), expand(batch)[:, kept] - means])
            root, target, marks = weigh(x, batch.column("_n").to_numpy(), batch.column("_hits").to_numpy())
            return np.column_stack([x * root[:, None], target * root, marks])
        found = column_moments(cells, matrix)[0]
        width = len(kept) + 2
        return *_least_squares(_raw(found)[:, :width]), found

    def reweighted(beta: np.ndarray, step: np.ndarray):
        def weigh(x, n, hits):
            eta = x @ beta
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
            w = np.maximum(p * (1.0 - p), 1e-14)
            moved = x @ step
            against = np.where(hits == n, moved < -_STILL, np.where(hits == 0, moved > _STILL, np.abs(moved) > _STILL))
            return np.sqrt(n * w), eta + (hits / n - p) / w, np.column_stack([(np.abs(eta) > _STEEP) & (np.abs(moved) > _GROWN), against])
        return weigh

    beta = step = np.zeros(len(kept) + 1)
    converged = separated = False
    rounds = 0
    inverse = np.eye(len(beta))
    while rounds < ROUNDS and not converged and not separated:
        following, inverse, found = solve(reweighted(beta, step))
        rounds += 1
        # the last step moved steep cells on and no cell away from its outcome: it is a direction
        # that separates, so the estimates have no end
        steep, against = found.means[-2:]
        separated = bool(steep > 0.0 and against == 0.0)
        step, beta = following - beta, following
        converged = not separated and bool(np.abs(step).max() <= 1e-9 * max(1.0, np.abs(beta).max()))
    back = _from_centred(means)
    errors = np.sqrt(np.diag(back @ (inverse @ inverse.T) @ back.T))
    used = ["(Intercept)", *[names[i] for i in kept]]
    return LogisticFit(
        Design(tuple(terms), design.levels), dict(zip(used, map(float, back @ beta))), dict(zip(used, map(float, errors))),
        [name for name in names if name not in set(used)], converged, separated, rounds)


def score_logistic(df: DataFrame, fit: LogisticFit, link: str = "link",
                   probability: str = "probability") -> DataFrame:
    """Log-odds and probability of every row; nulls and unseen levels give null."""
    slopes = {name: b for name, b in fit.beta.items() if name != "(Intercept)"}
    scored = linear_score(df, fit.design, slopes, {}, fit.beta["(Intercept)"], link)
    return scored.withColumn(probability, 1.0 / (1.0 + F.exp(-F.col(link))))
