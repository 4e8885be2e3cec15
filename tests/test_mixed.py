"""Mixed models against dense generalized least squares, closed forms and each other."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yardframe.models.design import Factor, Numeric
from yardframe.models.mixed import (
    _Satterthwaite, backward_step, fit_gathered, fit_mixed, fixed_ratio_intercepts, gather, minimise,
)


def make(n=300, a=20, b=7, c=0, seed=3, noise=1.0, sd=(0.8, 0.5, 0.4)):
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"x": rng.normal(size=n), "w": rng.normal(size=n),
                          "k": rng.choice(["u", "v", "w"], n),
                          "g": [f"g{i:02d}" for i in rng.integers(0, a, n)],
                          "h": [f"h{i}" for i in rng.integers(0, b, n)]})
    y = 1 + 0.5 * frame.x + noise * rng.normal(size=n)
    for column, size, scale in (("g", a, sd[0]), ("h", b, sd[1])):
        effects = dict(zip(sorted(frame[column].unique()), scale * rng.normal(size=size)))
        y = y + frame[column].map(effects)
    if c:
        frame["t"] = [f"t{i}" for i in rng.integers(0, c, n)]
        y = y + frame.t.map(dict(zip(sorted(frame.t.unique()), sd[2] * rng.normal(size=c))))
    frame["y"] = y
    return frame


def dense_reml(frame, x, groups, theta):
    """Deviance, coefficients, effects and residual variance from the full covariance matrix."""
    y = frame.y.to_numpy()
    v = np.eye(len(y))
    z = {g: pd.get_dummies(frame[g], dtype=float) for g in groups}
    for g in groups:
        v += theta[g] ** 2 * z[g].to_numpy() @ z[g].to_numpy().T
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ y)
    r = y - x @ beta
    free = len(y) - x.shape[1]
    s2 = r @ vi @ r / free
    deviance = (np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + free * (1 + math.log(2 * math.pi * s2)))
    effects = {g: dict(zip(z[g].columns, theta[g] ** 2 * z[g].to_numpy().T @ vi @ r)) for g in groups}
    return deviance, beta, effects, s2, s2 * np.linalg.inv(xvx)


TERMS = [Numeric("x"), Factor("k")]


def design(frame):
    return np.column_stack([np.ones(len(frame)), frame.x, frame.k == "v", frame.k == "w"]).astype(float)


def check_fit(fit, frame, groups):
    x = design(frame)
    deviance, beta, effects, s2, covariance = dense_reml(frame, x, groups, fit.theta)
    assert fit.deviance == pytest.approx(deviance, abs=1e-8)
    assert fit.beta == pytest.approx(beta, abs=1e-9)
    assert fit.sigma2 == pytest.approx(s2)
    assert fit.covariance == pytest.approx(covariance)
    for g in groups:
        got = {r["level"]: r["intercept"] for r in fit.group_intercepts(g).collect()}
        assert got == pytest.approx({k: beta[0] + v for k, v in effects[g].items()}, abs=1e-8)
    for g in groups:  # no better point near by
        for factor in (0.97, 1.03):
            moved = {**fit.theta, g: fit.theta[g] * factor}
            assert dense_reml(frame, x, groups, moved)[0] >= deviance - 1e-7


@pytest.mark.parametrize("groups,c", [(["g"], 0), (["g", "h"], 0), (["h", "g", "t"], 5)])
def test_fit_matches_dense_solution(spark, groups, c):
    frame = make(c=c)
    check_fit(fit_mixed(spark.createDataFrame(frame), F.col("y"), TERMS, groups), frame, groups)


@pytest.mark.parametrize("groups,c", [(["g"], 0), (["g", "h"], 0), (["g", "h", "t"], 5)])
def test_distributed_factor_gives_the_same_fit(spark, groups, c):
    frame = make(n=200, c=c)
    df = spark.createDataFrame(frame)
    near = fit_mixed(df, F.col("y"), TERMS, groups)
    far = fit_mixed(df, F.col("y"), TERMS, groups, local_cells=0)
    assert far.data.large == "g"
    assert near.converged and far.converged
    assert far.deviance == pytest.approx(near.deviance, abs=1e-8)
    assert far.beta == pytest.approx(near.beta, abs=1e-6)
    assert far.theta == pytest.approx(near.theta, abs=1e-6)
    for g in groups:
        a = {r["level"]: r["intercept"] for r in near.group_intercepts(g).collect()}
        b = {r["level"]: r["intercept"] for r in far.group_intercepts(g).collect()}
        assert b == pytest.approx(a, abs=1e-6)


def test_row_order_and_partitions_do_not_matter(spark):
    frame = make()
    one = fit_mixed(spark.createDataFrame(frame).repartition(1), F.col("y"), TERMS, ["g", "h"])
    other = fit_mixed(spark.createDataFrame(frame.sample(frac=1, random_state=1)).repartition(6),
                      F.col("y"), TERMS, ["h", "g"])
    assert one.theta == pytest.approx(other.theta, abs=1e-5)
    assert one.beta == pytest.approx(other.beta, abs=1e-6)


def test_balanced_one_way_equals_the_variance_table(spark):
    rng = np.random.default_rng(2)
    groups, size = 6, 5
    effects = np.repeat(3 * rng.normal(size=groups), size)
    frame = pd.DataFrame({"g": np.repeat([f"g{i}" for i in range(groups)], size),
                          "y": effects + rng.normal(size=groups * size)})
    fit = fit_mixed(spark.createDataFrame(frame), F.col("y"), [], ["g"])
    means = frame.groupby("g").y.mean()
    between = size * ((means - frame.y.mean()) ** 2).sum() / (groups - 1)
    within = ((frame.y - frame.g.map(means)) ** 2).sum() / (groups * (size - 1))
    table = {r["factor"]: r["variance"] for r in fit.variance_table().collect()}
    assert table["Residual"] == pytest.approx(within, rel=1e-5)
    assert table["g"] == pytest.approx((between - within) / size, rel=1e-5)
    degrees = fit.summary().first()["df"]
    assert degrees == pytest.approx(groups - 1, rel=1e-3)


def test_boundary_fit_has_no_group_variance(spark):
    frame = pd.DataFrame({"g": ["a", "b", "c"] * 20, "y": np.repeat(np.arange(20.0), 3)})
    fit = fit_mixed(spark.createDataFrame(frame), F.col("y"), [], ["g"])
    assert fit.theta["g"] == 0.0
    levels = [r["intercept"] for r in fit.group_intercepts("g").collect()]
    assert levels == pytest.approx([9.5] * 3)
    assert fit.summary().first()["df"] == pytest.approx(59, rel=1e-3)


def test_smaller_models_come_from_the_same_cross_products(spark):
    frame = make()
    df = spark.createDataFrame(frame)
    data = gather(df, F.col("y"), [*TERMS, Numeric("w")], ["g", "h"])
    cut = fit_gathered(data.subset(factors=["h"], terms=["x", "k"]))
    fresh = fit_mixed(df, F.col("y"), TERMS, ["h"])
    assert cut.deviance == pytest.approx(fresh.deviance, abs=1e-7)
    assert cut.beta == pytest.approx(fresh.beta, abs=1e-6)
    assert fit_gathered(data.subset(factors=[])).theta == {}


def test_backward_step_removes_what_does_not_matter(spark):
    frame = make(n=400, sd=(0.9, 0.0, 0.0), seed=8)
    data = gather(spark.createDataFrame(frame), F.col("y"), [*TERMS, Numeric("w")], ["g", "h"])
    fixed, random, fit = backward_step(data)
    assert list(fit.theta) == ["g"]
    assert [t.name for t in fit.data.design.terms] == ["x"]
    steps = {r["term"]: r["eliminated"] for r in fixed.collect()}
    assert steps["x"] == 0 and {steps["w"], steps["k"]} == {1, 2}
    assert {r["factor"]: r["eliminated"] for r in random.collect()} == {"g": 0, "h": 1}


def test_f_test_of_one_column_is_the_squared_t(spark):
    fit = fit_mixed(spark.createDataFrame(make()), F.col("y"), TERMS, ["g", "h"])
    tests = _Satterthwaite(fit)
    f, q, den, p = tests.f_test([1])
    row = {r["term"]: r for r in fit.summary().collect()}["x"]
    assert q == 1 and f == pytest.approx(row["t_value"] ** 2)
    assert den == pytest.approx(row["df"]) and p == pytest.approx(row["p_value"], abs=1e-9)
    assert tests.f_test([2, 3])[1] == 2


def test_fixed_ratio_closed_form(spark):
    frame = make(n=80, a=6)
    theta = 0.7
    got = {r["level"]: r["intercept"] for r in
           fixed_ratio_intercepts(spark.createDataFrame(frame), "g", "y", theta).collect()}
    _, beta, effects, _, _ = dense_reml(frame, np.ones((len(frame), 1)), ["g"], {"g": theta})
    assert got == pytest.approx({k: beta[0] + v for k, v in effects["g"].items()})


def test_minimiser_follows_a_curved_valley():
    def valley(x):
        a, b = x[1] - x[0] ** 2, 1 - x[0]
        return 100 * a * a + b * b, np.array([-400 * a * x[0] - 2 * b, 200 * a])
    found = minimise(valley, np.array([-1.2, 1.0]))
    assert found.converged and found.x == pytest.approx([1.0, 1.0], abs=1e-5)
    assert not minimise(valley, np.array([-1.2, 1.0]), rounds=3).converged


@pytest.mark.parametrize("local_cells", [20_000_000, 0])
def test_gradient_matches_differences(spark, local_cells):
    df = spark.createDataFrame(make(n=150, c=5))
    profile = fit_mixed(df, F.col("y"), TERMS, ["g", "h", "t"], local_cells=local_cells).profile
    x = np.log([0.3, 0.8, 0.05])
    _, gradient = profile.with_gradient(x)
    for i in range(3):
        e = 1e-5 * np.eye(3)[i]
        change = (profile.with_gradient(x + e)[0] - profile.with_gradient(x - e)[0]) / 2e-5
        assert gradient[i] == pytest.approx(change, rel=1e-5, abs=1e-5)


def test_offset_predictor_and_outcome(spark):
    frame = make(n=400)
    near = fit_mixed(spark.createDataFrame(frame), F.col("y"), TERMS, ["g", "h"])
    moved = frame.assign(x=1e9 + 1e3 * frame.x, y=frame.y + 1e7)
    far = fit_mixed(spark.createDataFrame(moved), F.col("y"), TERMS, ["g", "h"])
    assert far.data.names == near.data.names
    assert far.beta[1] * 1e3 == pytest.approx(near.beta[1], rel=1e-6)
    assert far.theta == pytest.approx(near.theta, rel=1e-5)
    table = {r["term"]: r for r in far.summary().collect()}
    plain = {r["term"]: r for r in near.summary().collect()}
    assert table["x"]["t_value"] == pytest.approx(plain["x"]["t_value"], rel=1e-5)
    assert far.converged and far.rounds < 60


def test_no_usable_row_is_an_error(spark):
    df = spark.createDataFrame([(None, "a", 1.0)], "y double, g string, x double")
    with pytest.raises(ValueError):
        fit_mixed(df, F.col("y"), [Numeric("x")], ["g"])
