"""Random-intercept models with crossed group factors, fitted by REML.

The method is penalized least squares with a profiled deviance (Bates, Maechler, Bolker and
Walker 2015, J. Stat. Softw. 67(1)). Spark reduces the rows to one cell per combination of group
levels and to cross-products. The factor with most levels has a diagonal block, so it is
eliminated; what is left to solve is as wide as the other factors and the fixed effects. When the
eliminated factor is too large for the driver it stays a distributed table, both while fitting and
in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yardframe.functions.nulls import without_nulls
from yardframe.models.design import Design, Term, complete_cases, plain
from yardframe.models.distributions import chi2_tail, f_tail, t_two_sided
from yardframe.models.moments import column_moments
from yardframe.operators.joins import settle

LOCAL_CELLS = 20_000_000  # numbers of the eliminated factor's table that the driver holds


# ---------------------------------------------------------------- cross-products


def level_cells(rows: DataFrame, groups: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """One row per combination of group levels: row count and the sum of each design column."""
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns.values())])


def factor_table(cells: DataFrame, factor: str, width: int) -> DataFrame:
    """Level, row count and column sums of one factor."""
    return cells.groupBy(F.col(factor).alias("level")).agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])


def pair_table(cells: DataFrame, first: str, second: str) -> DataFrame:
    """Row counts of the level pairs of two factors."""
    return (cells.groupBy(F.col(first).alias("level_a"), F.col(second).alias("level_b"))
                 .agg(F.sum("n").alias("n")))


@dataclass
class MixedData:
    """Cross-products of one model frame, enough for every smaller model on the same rows.

    All columns but the intercept are less their means, which ``centre`` holds (the outcome's last).
    """
    spark: SparkSession
    design: Design
    names: list[str]
    rows: int
    centre: np.ndarray
    products: np.ndarray                                  # [X y]'[X y]
    levels: dict[str, list[str]]                          # factors held on the driver
    sums: dict[str, np.ndarray]                           # level by [1 X y] column sums
    pairs: dict[tuple[str, str], np.ndarray]
    cells: DataFrame                                      # one row per level combination
    cell_names: list[str]                                 # design column behind each cell sum
    large: str | None = None                              # factor left distributed, if any

    @property
    def factors(self) -> list[str]:
        return [*([self.large] if self.large else []), *self.levels]

    def pair(self, a: str, b: str) -> np.ndarray:
        return self.pairs[a, b] if (a, b) in self.pairs else self.pairs[b, a].T

    def columns_of(self, term: str) -> list[str]:
        return [name for name in self.design.term_columns()[term] if name in self.names]

    def subset(self, factors: Sequence[str] | None = None,
               terms: Sequence[str] | None = None) -> MixedData:
        """The smaller model's cross-products, cut out of these without another scan."""
        factors = self.factors if factors is None else list(factors)
        design, names = self.design, self.names
        if terms is not None:
            for term in [t.name for t in self.design.terms if t.name not in set(terms)]:
                gone = set(self.design.term_columns()[term])
                design = design.without(term)
                names = [name for name in names if name not in gone]
        keep = [self.names.index(name) for name in names] + [len(self.names)]
        return MixedData(
            self.spark, design, names, self.rows, self.centre[keep], self.products[np.ix_(keep, keep)],
            {f: lv for f, lv in self.levels.items() if f in factors},
            {f: s[:, [0, *[k + 1 for k in keep]]] for f, s in self.sums.items() if f in factors},
            {p: m for p, m in self.pairs.items() if p[0] in factors and p[1] in factors},
            self.cells, self.cell_names, self.large if self.large in factors else None)

    def as_given(self) -> np.ndarray:
        """Coefficients of the columns as given from those of the centred columns, without the outcome's mean."""
        back = np.eye(len(self.names))
        back[0, 1:] = -self.centre[1:-1]
        return back


def gather(df: DataFrame, outcome: Column, terms: Sequence[Term], groups: Sequence[str],
           local_cells: int = LOCAL_CELLS) -> MixedData:
    """Reduce the complete rows to cross-products: one pass for means and R, one for the cells."""
    spark = df.sparkSession
    rows = complete_cases(df, outcome, terms, groups).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        design = Design.learn(rows, plain(terms))
        expand, all_names = design.expander(), design.names()
        moments = column_moments(rows.select(*design.inputs(), "_y"), lambda batch: np.column_stack(
            [expand(batch), batch.column("_y").to_numpy()])).get(0)
        if moments is None:
            raise ValueError("no complete row to fit on")
        kept = moments.independent(range(len(all_names)))
        moments = moments.take([*kept, len(all_names)])
        names = ["(Intercept)", *[all_names[i] for i in kept]]
        centre = np.concatenate([[0.0], moments.means])
        columns = {**design.columns(), "_y": F.col("_y")}
        used = {name: columns[name] - F.lit(float(c)) for name, c in zip([*names, "_y"], centre)}
        cells = settle(level_cells(rows, groups, used))
    finally:
        rows.unpersist()
    width = len(used)
    products = np.zeros((width, width))
    products[0, 0] = moments.n
    products[1:, 1:] = moments.products()
    counts = cells.agg(*[F.count_distinct(g).alias(g) for g in groups]).first().asDict()
    by_size = sorted(groups, key=lambda g: -counts[g])
    rest = sum(counts[g] for g in by_size[1:])
    large = by_size[0] if counts[by_size[0]] * (rest + width) > local_cells else None
    held = [g for g in by_size if g != large]
    levels, sums, pairs = {}, {}, {}
    for g in held:
        table = factor_table(cells, g, width).withColumn("level", F.col("level").cast("string")).toArrow().sort_by("level")
        levels[g] = table.column("level").to_pylist()
        sums[g] = np.column_stack([c.to_numpy().astype(float) for c in table.columns[1:]])
    places = {g: pa.array(levels[g], pa.string()) for g in held}
    for i, a in enumerate(held):
        for b in held[i + 1:]:
            table = pair_table(cells, a, b).select(
                F.col("level_a").cast("string"), F.col("level_b").cast("string"), "n").toArrow().combine_chunks()
            at = [pc.index_in(table.column(c), value_set=places[g]).to_numpy() for c, g in (("level_a", a), ("level_b", b))]
            matrix = np.zeros((len(levels[a]), len(levels[b])))
            matrix[at[0], at[1]] = table.column("n").to_numpy()
            pairs[a, b] = matrix
    return MixedData(spark, design, names, int(round(moments.n)), centre, products, levels, sums,
                     pairs, cells, list(used), large)


# ---------------------------------------------------------------- profiled deviance


@dataclass
class _Block:
    """The eliminated factor's part for a given theta, with tau = theta^2 and n the rows of a level:
    sum of log(1 + tau n), sum of n / (1 + tau n), the Schur term and its derivative in tau."""
    log_det: Callable[[float], float]
    trace: Callable[[float], float]
    schur: Callable[[float], np.ndarray]
    slope: Callable[[float], np.ndarray]


class _Profile:
    """REML deviance of one model as a function of the relative standard deviations."""

    def __init__(self, data: MixedData, first: str, others: Sequence[str], block: _Block):
        self.data, self.first, self.others, self.block = data, first, list(others), block
        self.widths = [len(data.levels[g]) for g in others]
        self.q, self.p = sum(self.widths), len(data.names)
        starts = np.cumsum([0, *self.widths])
        self.slices = [slice(starts[i], starts[i + 1]) for i in range(len(self.widths))]
        size = self.q + self.p + 1
        full = np.zeros((size, size))
        for i, g in enumerate(others):
            full[self.slices[i], self.slices[i]] = np.diag(data.sums[g][:, 0])
            full[self.slices[i], self.q:] = data.sums[g][:, 1:]
            full[self.q:, self.slices[i]] = data.sums[g][:, 1:].T
            for j in range(i + 1, len(others)):
                m = data.pair(g, others[j])
                full[self.slices[i], self.slices[j]], full[self.slices[j], self.slices[i]] = m, m.T
        full[self.q:, self.q:] = data.products
        self.full = full
        self._recent: dict[float, tuple[float, np.ndarray]] = {}

    def _reduced(self, theta1: float) -> tuple[float, np.ndarray]:
        """Log-determinant and reduced cross-products; the last few points are remembered,
        as one may cost a Spark job."""
        if theta1 not in self._recent:
            if len(self._recent) >= 8:
                self._recent.pop(next(iter(self._recent)))
            self._recent[theta1] = (0.0, self.full) if theta1 == 0.0 else (
                self.block.log_det(theta1), self.full - self.block.schur(theta1))
        return self._recent[theta1]

    def solve(self, theta: Sequence[float]) -> dict:
        """Solve the penalized least squares problem at ``theta`` (first factor first)."""
        q, p, data = self.q, self.p, self.data
        log_det, m = self._reduced(float(theta[0]))
        scale = np.concatenate([np.full(w, t) for w, t in zip(self.widths, theta[1:])]) \
            if self.widths else np.zeros(0)
        xx, xy, yy = m[q:q + p, q:q + p], m[q:q + p, -1], m[-1, -1]
        if q:
            lower = np.linalg.cholesky(scale[:, None] * m[:q, :q] * scale + np.eye(q))
            right = np.linalg.solve(lower, scale[:, None] * m[:q, q:])
            rzx, cu = right[:, :p], right[:, p]
            log_det += 2.0 * float(np.log(np.diag(lower)).sum())
            xx, xy, yy = xx - rzx.T @ rzx, xy - rzx.T @ cu, yy - cu @ cu
        beta = np.linalg.solve(xx, xy)
        rss = float(yy - beta @ xy)
        free = data.rows - p
        deviance = (log_det + float(np.linalg.slogdet(xx)[1])
                    + free * (1.0 + math.log(2.0 * math.pi * rss / free)))
        effects = np.zeros(0)
        if q:
            effects = scale * np.linalg.solve(lower.T, cu - rzx @ beta)
        return {"deviance": deviance, "beta": beta, "rss": rss, "log_det": log_det, "xx": xx,
                "effects": effects}

    def deviance(self, theta: Sequence[float]) -> float:
        return self.solve(theta)["deviance"]

    def with_gradient(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """Deviance and its gradient where ``x`` is the logarithm of each variance ratio theta^2."""
        theta = np.exp(0.5 * x)
        solved = self.solve(theta)
        q, p, free, rss = self.q, self.p, self.data.rows - self.p, solved["rss"]
        _, m = self._reduced(float(theta[0]))
        scale = np.concatenate([np.full(w, t) for w, t in zip(self.widths, theta[1:])]) if q else np.zeros(0)
        c_pp = np.linalg.inv(solved["xx"])
        c_qq, c_qp = np.zeros((0, 0)), np.zeros((0, p))
        if q:
            inverse = np.linalg.inv(scale[:, None] * m[:q, :q] * scale + np.eye(q))
            k = inverse @ (scale[:, None] * m[:q, q:q + p])
            c_qq, c_qp = inverse + k @ c_pp @ k.T, -k @ c_pp
        gradient = np.zeros(len(theta))
        u = solved["effects"] / scale if q else np.zeros(0)
        for i, part in enumerate(self.slices):
            gradient[i + 1] = (self.widths[i] - float(np.trace(c_qq[part, part]))
                               - free * float(u[part] @ u[part]) / rss)
        slope = self.block.slope(float(theta[0]))
        traced = (float((c_qq * (scale[:, None] * slope[:q, :q] * scale)).sum())
                  + 2.0 * float((c_qp * (scale[:, None] * slope[:q, q:q + p])).sum())
                  + float((c_pp * slope[q:q + p, q:q + p]).sum()))
        v = np.concatenate([-solved["effects"], -solved["beta"], [1.0]])
        gradient[0] = float(theta[0]) ** 2 * (self.block.trace(float(theta[0])) - traced - free * float(v @ slope @ v) / rss)
        return solved["deviance"], gradient

    def free_deviance(self, theta: Sequence[float], sigma: float) -> float:
        """Deviance with the residual standard deviation as a parameter of its own."""
        s = self.solve(theta)
        free = self.data.rows - self.p
        return (s["log_det"] + float(np.linalg.slogdet(s["xx"])[1])
                + free * math.log(2.0 * math.pi * sigma ** 2) + s["rss"] / sigma ** 2)


def _local_block(counts: np.ndarray, table: np.ndarray) -> _Block:
    def gram(weight: np.ndarray) -> np.ndarray:
        return (table * weight[:, None]).T @ table
    return _Block(
        lambda theta: float(np.log1p(theta ** 2 * counts).sum()),
        lambda theta: float((counts / (1.0 + theta ** 2 * counts)).sum()),
        lambda theta: gram(theta ** 2 / (1.0 + theta ** 2 * counts)),
        lambda theta: gram((1.0 + theta ** 2 * counts) ** -2.0))


_NO_BLOCK = _Block(*[lambda theta: 0.0] * 4)


def _padded(counts: str, length: int) -> Column:
    """Array of the given length from a map of position to count, zero where absent."""
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(length - 1).cast("bigint")),
                       lambda i: F.coalesce(F.try_element_at(F.col(counts), i), F.lit(0.0)))


def _level_rows(data: MixedData, others: Sequence[str]) -> DataFrame:
    """Row per level of the distributed factor: row count, and its sums over all other columns.

    Another factor's counts fill one slot per level, so a row is as long as the reduced system.
    """
    cells = data.cells
    used = [f"s{data.cell_names.index(name)}" for name in [*data.names, "_y"]]
    out = cells.groupBy(F.col(data.large).alias("level")).agg(
        F.sum("n").cast("double").alias("n"), *[F.sum(s).alias(s) for s in used])
    arrays = []
    for k, g in enumerate(others):
        index = data.spark.createDataFrame(list(enumerate(data.levels[g])), ["place", g])
        entries = (cells.select(F.col(data.large).alias("level"), g, "n")
                        .join(F.broadcast(index), g)
                        .groupBy("level", "place").agg(F.sum("n").cast("double").alias("n"))
                        .groupBy("level")
                        .agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias(f"m{k}")))
        out = out.join(entries, "level")
        arrays.append(_padded(f"m{k}", len(data.levels[g])))
    return out.select("level", "n", F.concat(*arrays, F.array(*used)).alias("w"))


def _spread_block(rows: DataFrame) -> _Block:
    """A distributed factor: its Schur term is the Gram matrix of its weighted level rows."""
    def grown(theta: float) -> Column:
        return 1.0 + F.lit(theta ** 2) * F.col("n")

    def total(value: Column) -> float:
        return float(rows.agg(F.sum(value)).first()[0])

    def gram(root: Column) -> np.ndarray:
        vectors = rows.select(array_to_vector(F.transform("w", lambda v: v * root)).alias("v"))
        old = MLUtils.convertVectorColumnsFromML(vectors, "v")
        return RowMatrix(old).computeGramianMatrix().toArray()
    return _Block(
        lambda theta: total(F.log1p(F.lit(theta ** 2) * F.col("n"))),
        lambda theta: total(F.col("n") / grown(theta)),
        lambda theta: gram(F.sqrt(F.lit(theta ** 2) / grown(theta))),
        lambda theta: gram(1.0 / grown(theta)))


# ---------------------------------------------------------------- minimisation

ROUNDS = 200
_LOWEST, _HIGHEST = -40.0, 40.0
_STILL = 1e-8  # a shorter step ends the search: the gradient alone says little where the deviance is flat


@dataclass(frozen=True)
class Minimum:
    """Where a search ended."""
    x: np.ndarray
    value: float
    converged: bool
    rounds: int


def _bounded_step(hessian: np.ndarray, gradient: np.ndarray, radius: float) -> np.ndarray:
    """Minimum of the quadratic model within the radius."""
    sizes, vectors = np.linalg.eigh(hessian)
    g = vectors.T @ gradient

    def at(shift: float) -> np.ndarray:
        return -g / (sizes + shift)

    low = max(0.0, -sizes[0]) + 1e-12 * max(1.0, abs(sizes[-1]))
    step = at(low if sizes[0] <= 0 else 0.0)
    if np.linalg.norm(step) > radius or sizes[0] <= 0:
        high = max(low, 1e-12)
        while np.linalg.norm(at(high)) > radius:
            high *= 4.0
        for _ in range(200):
            middle = 0.5 * (low + high)
            low, high = (middle, high) if np.linalg.norm(at(middle)) > radius else (low, middle)
        step = at(high)
    return vectors @ step


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray,
             tolerance: float = 1e-7, rounds: int = ROUNDS) -> Minimum:
    """Trust-region search with symmetric rank-one updates; ``f`` gives value and gradient.

    Near the minimum, where values differ by rounding only, a step counts when it lowers the gradient.
    """
    x = np.asarray(start, dtype=float)
    value, gradient = f(x)
    hessian, radius = np.eye(len(x)) * max(1.0, float(np.abs(gradient).max(initial=0.0))), 1.0
    for done in range(rounds):
        size = float(np.abs(gradient).max(initial=0.0))
        moved = np.clip(x + _bounded_step(hessian, gradient, radius), _LOWEST, _HIGHEST)
        step = moved - x
        if size <= 1e-13 or np.linalg.norm(step) <= (_STILL if size <= tolerance else 1e-12):
            return Minimum(x, value, True, done)
        new_value, new_gradient = f(moved)
        expected = -float(gradient @ step + 0.5 * step @ hessian @ step)
        noise = 1e-12 * max(1.0, abs(value))
        good = (value - new_value) / expected if expected > 0 else -1.0
        if abs(value - new_value) <= 10 * noise:
            good = 1.0 if float(np.abs(new_gradient).max()) < size else -1.0
        miss = new_gradient - gradient - hessian @ step
        along = float(miss @ step)
        if abs(along) > 1e-8 * np.linalg.norm(miss) * np.linalg.norm(step):
            hessian = hessian + np.outer(miss, miss) / along
        if good > 0.75 and np.linalg.norm(step) > 0.8 * radius:
            radius = min(2.0 * radius, 8.0)
        elif good < 0.1:
            radius = 0.25 * float(np.linalg.norm(step))
        if good > 1e-4:
            x, value, gradient = moved, new_value, new_gradient
    return Minimum(x, value, False, rounds)


# ---------------------------------------------------------------- fit and tables


@dataclass
class MixedFit:
    """A fitted model."""
    data: MixedData
    theta: dict[str, float]
    beta: np.ndarray
    sigma2: float
    deviance: float
    covariance: np.ndarray
    effects: dict[str, np.ndarray] = field(repr=False)
    profile: _Profile = field(repr=False)
    level_rows: DataFrame | None = field(default=None, repr=False)
    converged: bool = True
    rounds: int = 0

    @property
    def log_likelihood(self) -> float:
        return -0.5 * self.deviance

    @property
    def parameters(self) -> int:
        return len(self.beta) + len(self.theta) + 1

    def status(self) -> DataFrame:
        """Deviance, whether the search converged, and its rounds."""
        return self.data.spark.createDataFrame([(float(self.deviance), self.converged, self.rounds)],
                                               "deviance double, converged boolean, rounds int")

    def group_intercepts(self, factor: str) -> DataFrame:
        """Fixed intercept plus random effect of every level: ``level``, ``intercept``, ``factor``."""
        base = float(self.beta[0])
        if factor != self.data.large:
            rows = [(level, base + float(b), factor)
                    for level, b in zip(self.data.levels[factor], self.effects[factor])]
            return self.data.spark.createDataFrame(rows, "level string, intercept double, factor string")
        centred = np.concatenate([[base - self.data.centre[-1] + self.data.centre[1:-1] @ self.beta[1:]], self.beta[1:]])
        others = np.concatenate([*[self.effects[g] for g in self.profile.others], centred])
        weights = F.array(*[F.lit(float(v)) for v in [*-others, 1.0]])
        rest = F.aggregate(F.zip_with("w", weights, lambda w, k: w * k), F.lit(0.0), lambda a, v: a + v)
        square = F.lit(self.theta[factor] ** 2)
        return self.level_rows.select(
            F.col("level").cast("string").alias("level"),
            (F.lit(base) + square / (1.0 + square * F.col("n")) * rest).alias("intercept"),
            F.lit(factor).alias("factor"))

    def variance_table(self) -> DataFrame:
        rows = [(g, float(t ** 2 * self.sigma2), float(t * math.sqrt(self.sigma2)))
                for g, t in self.theta.items()]
        rows.append(("Residual", float(self.sigma2), math.sqrt(self.sigma2)))
        return self.data.spark.createDataFrame(rows, "factor string, variance double, std_dev double")

    def summary(self) -> DataFrame:
        """Fixed effects with t-tests on Satterthwaite degrees of freedom."""
        tests = _Satterthwaite(self)
        rows = []
        for i, name in enumerate(self.data.names):
            error = math.sqrt(self.covariance[i, i])
            degrees = tests.degrees(np.eye(len(self.beta))[i])
            t = self.beta[i] / error
            rows.append((name, float(self.beta[i]), error, degrees, float(t), t_two_sided(t, degrees)))
        return self.data.spark.createDataFrame(
            rows, "term string, estimate double, std_error double, df double, t_value double, p_value double")


def fit_gathered(data: MixedData) -> MixedFit:
    """Fit the model that ``data`` holds."""
    others = sorted(data.levels, key=lambda g: -len(data.levels[g]))
    level_rows = None
    if data.large:
        first = data.large
        level_rows = settle(_level_rows(data, others))
        profile = _Profile(data, first, others, _spread_block(level_rows))
    elif others:
        first, others = others[0], others[1:]
        table = np.hstack([*[data.pair(first, g) for g in others], data.sums[first][:, 1:]])
        profile = _Profile(data, first, others, _local_block(data.sums[first][:, 0], table))
    else:
        first, profile = None, _Profile(data, "", [], _NO_BLOCK)
    theta, found = np.zeros(1), Minimum(np.zeros(0), 0.0, True, 0)
    if first:
        found = minimise(profile.with_gradient, np.full(1 + len(others), math.log(0.25)))
        theta, value = np.exp(0.5 * found.x), found.value
        for k in range(len(theta)):  # a variance that is as good at zero is zero
            edge = theta.copy()
            edge[k] = 0.0
            at_edge = profile.deviance(edge)
            if at_edge <= value + 1e-9 * max(1.0, 1e-4 * abs(value)):
                theta, value = edge, at_edge
    solved = profile.solve(theta)
    sigma2 = solved["rss"] / (data.rows - profile.p)
    effects = {g: solved["effects"][s] for g, s in zip(others, profile.slices)}
    if first and first != data.large:
        rest = data.sums[first][:, -1] - data.sums[first][:, 1:-1] @ solved["beta"]
        for g in others:
            rest = rest - data.pair(first, g) @ effects[g]
        effects[first] = theta[0] ** 2 / (1.0 + theta[0] ** 2 * data.sums[first][:, 0]) * rest
    names = [first, *others] if first else []
    back = data.as_given()
    beta = back @ solved["beta"]
    beta[0] += data.centre[-1]
    return MixedFit(data, {g: float(t) for g, t in zip(names, theta)}, beta, sigma2, solved["deviance"],
                    sigma2 * back @ np.linalg.inv(solved["xx"]) @ back.T, effects, profile, level_rows,
                    found.converged, found.rounds)


def fit_mixed(df: DataFrame, outcome: Column, terms: Sequence[Term], groups: Sequence[str],
              local_cells: int = LOCAL_CELLS) -> MixedFit:
    """REML fit of fixed ``terms`` and one random intercept per group factor."""
    return fit_gathered(gather(df, outcome, terms, groups, local_cells))


class _Satterthwaite:
    """Degrees of freedom from numeric derivatives in the variance parameters
    (Kuznetsova, Brockhoff and Christensen 2017, J. Stat. Softw. 82(13))."""

    def __init__(self, fit: MixedFit):
        self.fit = fit
        self.profile = fit.profile
        theta = np.array(list(fit.theta.values()))
        self.inner = [i for i, t in enumerate(theta) if t > 0.0]
        self.theta = theta if len(theta) else np.zeros(1)
        start = np.array([*theta[self.inner], math.sqrt(fit.sigma2)])
        steps = 1e-3 * np.maximum(np.abs(start), 1e-2)
        dim = len(start)
        hessian = np.zeros((dim, dim))
        centre = self._deviance(start)
        for i in range(dim):
            for j in range(i, dim):
                ei, ej = steps[i] * np.eye(dim)[i], steps[j] * np.eye(dim)[j]
                if i == j:
                    value = (self._deviance(start + ei) - 2 * centre + self._deviance(start - ei)) / steps[i] ** 2
                else:
                    value = (self._deviance(start + ei + ej) - self._deviance(start + ei - ej)
                             - self._deviance(start - ei + ej) + self._deviance(start - ei - ej)
                             ) / (4 * steps[i] * steps[j])
                hessian[i, j] = hessian[j, i] = value
        sizes, vectors = np.linalg.eigh(hessian)
        usable = sizes > 1e-6 * max(sizes.max(), 1e-300)
        self.parameter_covariance = 2.0 * (vectors[:, usable] / sizes[usable]) @ vectors[:, usable].T
        self.gradients = [
            (self._beta_covariance(start + steps[i] * np.eye(dim)[i])
             - self._beta_covariance(start - steps[i] * np.eye(dim)[i])) / (2 * steps[i])
            for i in range(dim)]

    def _full(self, point: np.ndarray) -> np.ndarray:
        theta = self.theta.copy()
        theta[self.inner] = point[:-1]
        return theta

    def _deviance(self, point: np.ndarray) -> float:
        return self.profile.free_deviance(self._full(point), point[-1])

    def _beta_covariance(self, point: np.ndarray) -> np.ndarray:
        back = self.fit.data.as_given()
        return point[-1] ** 2 * back @ np.linalg.inv(self.profile.solve(self._full(point))["xx"]) @ back.T

    def degrees(self, contrast: np.ndarray) -> float:
        variance = contrast @ self.fit.covariance @ contrast
        gradient = np.array([contrast @ g @ contrast for g in self.gradients])
        return float(2.0 * variance ** 2 / (gradient @ self.parameter_covariance @ gradient))

    def f_test(self, columns: Sequence[int]) -> tuple[float, int, float, float]:
        """F value, numerator and denominator degrees of freedom and p-value of some columns."""
        chosen = np.eye(len(self.fit.beta))[list(columns)]
        sizes, vectors = np.linalg.eigh(chosen @ self.fit.covariance @ chosen.T)
        contrasts = vectors.T @ chosen
        t2 = (contrasts @ self.fit.beta) ** 2 / sizes
        q = len(t2)
        parts = [self.degrees(c) for c in contrasts]
        f = float(t2.mean())
        if q == 1:
            den = parts[0]
        else:
            total = sum(v / (v - 2.0) for v in parts if v > 2.0)
            den = 2.0 * total / (total - q) if total > q else 2.0
        return f, q, den, f_tail(f, q, den)


def backward_step(data: MixedData, alpha_random: float = 0.1, alpha_fixed: float = 0.05
                  ) -> tuple[DataFrame, DataFrame, MixedFit]:
    """Backward elimination: random terms by likelihood ratio, then fixed terms by F-test.

    Every model is cut out of the one set of cross-products. Returns the fixed-term table, the
    random-term table and the final fit; ``eliminated`` is the order of removal, 0 for kept terms.
    """
    spark = data.spark
    fit = fit_gathered(data)
    random_rows, order = [], 0
    while fit.theta:
        tests = {}
        for g in fit.theta:
            less = fit_gathered(fit.data.subset(factors=[f for f in fit.theta if f != g]))
            ratio = max(less.deviance - fit.deviance, 0.0)
            tests[g] = (less, ratio, chi2_tail(ratio, 1))
        worst = max(tests, key=lambda g: tests[g][2])
        drop = tests[worst][2] > alpha_random
        order += 1
        for g in [worst] if drop else list(tests):
            less, ratio, p = tests[g]
            random_rows.append((g, order if drop else 0, less.parameters, less.log_likelihood,
                                2 * less.parameters - 2 * less.log_likelihood, ratio, 1, p))
        if not drop:
            break
        fit = tests[worst][0]
    fixed_rows, order = [], 0
    while True:
        satterthwaite = _Satterthwaite(fit)
        terms = [t.name for t in fit.data.design.terms if fit.data.columns_of(t.name)]
        tests = {}
        for term in terms:
            f, q, den, p = satterthwaite.f_test([fit.data.names.index(c) for c in fit.data.columns_of(term)])
            tests[term] = (f * fit.sigma2 * q, f * fit.sigma2, q, den, f, p)
        worst = max(tests, key=lambda t: tests[t][-1], default=None)
        drop = worst is not None and tests[worst][-1] > alpha_fixed
        order += 1
        for term in [worst] if drop else terms:
            fixed_rows.append((term, order if drop else 0, *tests[term]))
        if not drop:
            break
        fit = fit_gathered(fit.data.subset(terms=[t for t in terms if t != worst]))
    fixed = spark.createDataFrame(
        fixed_rows, "term string, eliminated int, sum_sq double, mean_sq double, num_df int, "
                    "den_df double, f_value double, p_value double")
    random = spark.createDataFrame(
        random_rows, "factor string, eliminated int, npar int, log_likelihood double, aic double, "
                     "lrt double, df int, p_value double")
    return fixed, random, fit


def fixed_ratio_intercepts(rows: DataFrame, group: str, outcome: str, theta: float) -> DataFrame:
    """Group intercepts of the one-factor, intercept-only model at a given variance ratio.

    Closed form: with w = n / (1 + n theta^2), the intercept is the w-weighted mean of the group
    means and each group is shrunk towards it.
    """
    square = theta ** 2
    groups = settle(without_nulls(rows, [group, outcome]).groupBy(F.col(group).alias("level"))
                    .agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean")))
    weight = F.col("n") / (1.0 + F.col("n") * F.lit(square))
    base = groups.agg((F.sum(weight * F.col("mean")) / F.sum(weight)).alias("b")).first()["b"]
    centre = F.lit(base).cast("double")
    return groups.select(
        "level", "n",
        (centre + weight * F.lit(square) * (F.col("mean") - centre)).alias("intercept"))
