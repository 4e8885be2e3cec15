"""The shared least-squares reduction: large offsets in every fit, wide factors, separated outcomes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yardframe.models import design as design_module
from yardframe.models.design import Design, Factor, Numeric
from yardframe.models.linear import (
    breusch_pagan, fit_linear, fit_logistic, predict, robust_covariance, score_logistic,
)
from yardframe.models.moments import Moments, column_moments, merged
from yardframe.models.resample import cv_backward_subset, fold_of


@pytest.fixture(scope="module")
def far():
    rng = np.random.default_rng(11)
    n = 1500
    x = 1e9 + rng.normal(0, 1e3, n)
    z = rng.normal(size=n)
    y = 2.5 * (x - 1e9) + z + rng.normal(size=n) * (1 + 0.5 * np.abs(z))
    return pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "y": y, "g": rng.choice(["a", "b"], n)})


TERMS = [Numeric("x"), Numeric("z")]


def dense(frame):
    return np.column_stack([np.ones(len(frame)), frame.x - 1e9, frame.z])


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(500, 4)) * [1, 1e-3, 1e6, 1] + [0, 1e3, 1e9, 5]
    whole = Moments.of(values)
    for cuts in ([3], [1, 2, 400], [250, 499]):
        parts = merged(Moments.of(p) for p in np.split(values, cuts))
        assert parts.means == pytest.approx(whole.means, rel=1e-15)
        assert parts.products() == pytest.approx(whole.products(), rel=1e-9, abs=1e-6)
    assert whole.independent(range(4)) == [0, 1, 2, 3]
    assert Moments.of(np.column_stack([values, np.full(500, 7.0), values[:, 2] * 3])).independent(range(6)) == [0, 1, 2, 3]


def test_moments_of_groups_and_of_nothing(spark, far):
    df = spark.createDataFrame(far).select("x", "y", "id")
    def expand(batch):
        return np.column_stack([batch.column("x").to_numpy(), batch.column("y").to_numpy()])
    by = column_moments(df.repartition(40), expand, by=F.col("id") % 3)
    for k, m in by.items():
        part = far[far.id % 3 == k]
        assert m.n == len(part) and m.means == pytest.approx(part[["x", "y"]].mean().to_numpy(), rel=1e-14)
        assert m.products() / m.n == pytest.approx(np.cov(part.x, part.y, ddof=0), rel=1e-9)
    assert column_moments(df.where("id < 0"), expand) == {}


def test_offset_linear_diagnostics(spark, far):
    df = spark.createDataFrame(far)
    fit = fit_linear(df, F.col("y"), TERMS)
    x, y = dense(far), far.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.beta[1:] == pytest.approx(beta[1:], rel=1e-8)
    residual = y - x @ beta
    e2 = residual ** 2
    aux = e2 - x @ np.linalg.lstsq(x, e2, rcond=None)[0]
    test = breusch_pagan(df, F.col("y"), fit)
    assert test["df"] == 2
    assert test["statistic"] == pytest.approx(len(x) * (1 - aux @ aux / ((e2 - e2.mean()) ** 2).sum()), rel=1e-8)
    inverse = np.linalg.inv(x.T @ x)
    weighted = x * (residual / (1 - np.einsum("ij,jk,ik->i", x, inverse, x)))[:, None]
    want = np.sqrt(np.diag(inverse @ weighted.T @ weighted @ inverse))
    got = np.sqrt(np.diag(robust_covariance(df, F.col("y"), fit)))
    assert got[1:] == pytest.approx(want[1:], rel=1e-8)


def test_offset_cross_validation(spark, far):
    df = spark.createDataFrame(far)
    search = cv_backward_subset(df, F.col("y"), TERMS, ["id"], sizes=[1, 2], folds=5, seed=4)
    folds = df.select("id", fold_of(["id"], 4, 5).alias("f")).orderBy("id").toPandas().f.to_numpy()
    x, y = dense(far), far.y.to_numpy()
    for size, columns in ((1, [0, 1]), (2, [0, 1, 2])):
        errors = []
        for f in range(5):
            b = np.linalg.lstsq(x[folds != f][:, columns], y[folds != f], rcond=None)[0]
            errors.append(math.sqrt(((y[folds == f] - x[folds == f][:, columns] @ b) ** 2).mean()))
        row = search.results.filter(F.col("nvmax") == size).first()
        assert row["rmse"] == pytest.approx(np.mean(errors), rel=1e-8)


def test_wide_factor_gives_the_same_fit(spark, far, monkeypatch):
    rng = np.random.default_rng(2)
    frame = far.assign(team=[f"t{i:03d}" for i in rng.integers(0, 60, len(far))], x=far.x - 1e9)
    frame["y"] = frame.y + frame.team.str[1:].astype(int) * 0.1
    df = spark.createDataFrame(frame)
    terms = [Numeric("x"), Factor("team", ref="t007"), Numeric("z"), Factor("g")]
    listed = fit_linear(df, F.col("y"), terms)
    monkeypatch.setattr(design_module, "WIDE", 10)
    wide = fit_linear(df, F.col("y"), terms)
    assert wide.design.wide.name == "team"
    a = {r["term"]: r for r in listed.summary(spark).collect()}
    b = {r["term"]: r for r in wide.summary(spark).collect()}
    assert set(a) == set(b)
    for term, row in a.items():
        for column in ("estimate", "std_error", "t_value", "p_value"):
            assert b[term][column] == pytest.approx(row[column], rel=1e-7, abs=1e-9)
    assert wide.r2 == pytest.approx(listed.r2) and wide.df_residual == listed.df_residual
    scored = predict(predict(df, listed, "p"), wide, "q")
    assert scored.filter(F.abs(F.col("p") - F.col("q")) > 1e-8).isEmpty()
    unseen = predict(df.withColumn("team", F.lit("nobody")), wide, "p")
    assert unseen.filter(F.col("p").isNotNull()).isEmpty()
    assert breusch_pagan(df, F.col("y"), wide) == pytest.approx(breusch_pagan(df, F.col("y"), listed), rel=1e-7)
    robust = robust_covariance(df, F.col("y"), listed)
    places = [listed.names.index(n) for n in wide.names]
    assert robust_covariance(df, F.col("y"), wide) == pytest.approx(robust[np.ix_(places, places)], rel=1e-6)


def test_factor_of_ten_thousand_levels(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 10_000).cast("string").alias("k"), (F.hash("id") % 1000 / 100).alias("x"))
    df = df.withColumn("y", 3 * F.col("x") + F.col("k").cast("double") / 100)
    fit = fit_linear(df, F.col("y"), [Factor("k"), Numeric("x")])
    assert fit.parameters == 10_001 and fit.beta[0] == pytest.approx(3.0)
    table = fit.summary(spark)
    assert table.count() == 10_001
    assert table.filter("term = 'k25'").first()["estimate"] == pytest.approx(0.25)


def test_levels_by_batch_look_up(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 1.0), ("c", 4.0)], "g string, v double")
    made = Design.learn(df, [Factor("g", ref="b"), Numeric("v")])
    assert made.names() == ["ga", "gc", "v"]
    batch = df.select(*made.inputs()).toArrow().to_batches()
    assert np.vstack([made.expander()(b) for b in batch]).tolist() == [[0, 0, 2], [1, 0, 1], [0, 1, 4]]


def logistic(x, y):
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return beta


def test_logistic_with_offset(spark, far):
    rng = np.random.default_rng(3)
    hit = (rng.random(len(far)) < 1 / (1 + np.exp(-(far.x - 1e9) / 1e3 - far.z))).astype(int)
    df = spark.createDataFrame(far.assign(hit=hit))
    fit = fit_logistic(df, F.col("hit"), TERMS)
    want = logistic(np.column_stack([np.ones(len(far)), (far.x - 1e9) / 1e3, far.z]), hit.to_numpy())
    assert fit.converged and not fit.separated and fit.rounds < 15
    assert [fit.beta["x"] * 1e3, fit.beta["z"]] == pytest.approx(want[1:], rel=1e-7)


def test_separated_outcomes_are_found(spark):
    rng = np.random.default_rng(6)
    x, z = rng.normal(size=400), rng.normal(size=400)
    frame = pd.DataFrame({"x": x, "z": z, "g": rng.choice(["a", "b", "c"], 400),
                          "whole": (x + 0.5 * z > 0).astype(int), "fair": (x + rng.normal(size=400) > 0).astype(int)})
    frame["part"] = np.where(frame.g == "c", 1, frame.fair)  # one level has a single outcome
    df = spark.createDataFrame(frame)
    for outcome, separated in (("whole", True), ("part", True), ("fair", False)):
        fit = fit_logistic(df, F.col(outcome), [Numeric("x"), Numeric("z"), Factor("g")])
        assert (fit.separated, fit.converged) == (separated, not separated)
        assert {(r["converged"], r["separated"]) for r in fit.coefficients(spark).collect()} == {(not separated, separated)}


def test_steep_but_not_separated(spark):
    x = np.concatenate([np.linspace(-40, -1, 200), np.linspace(1, 40, 200), [0.5, -0.5]])
    y = np.concatenate([np.zeros(200), np.ones(200), [0, 1]]).astype(int)
    fit = fit_logistic(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), F.col("y"), [Numeric("x")])
    assert fit.converged and not fit.separated
    assert [fit.beta["(Intercept)"], fit.beta["x"]] == pytest.approx(logistic(np.column_stack([np.ones(402), x]), y), abs=1e-6)
    scored = score_logistic(spark.createDataFrame([(0.0,), (None,)], "x double"), fit).collect()
    assert scored[1]["link"] is None and scored[1]["probability"] is None
