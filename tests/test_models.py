"""Least squares, logistic regression, diagnostics and resampling against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from yardframe.models.design import Design, Factor, Numeric, cross_products
from yardframe.models.distributions import chi2_tail, f_tail, t_two_sided
from yardframe.models.linear import (
    breusch_pagan, fit_linear, fit_logistic, predict, rmse, robust_covariance, score_logistic,
    trend_line,
)
from yardframe.models.resample import cv_backward_subset, fold_of, stratified_split


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 400
    x, z = rng.normal(size=n), rng.normal(size=n)
    g = rng.choice(["a", "b", "c"], n)
    y = 1 + 2 * x - z + np.select([g == "b", g == "c"], [0.5, -1.0], 0.0) + rng.normal(size=n) * (1 + 0.5 * np.abs(x))
    return pd.DataFrame({"id": np.arange(n), "x": x, "z": z, "g": g, "y": y,
                         "hit": (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)})


def dense(frame, names=("x", "z")):
    return np.column_stack([np.ones(len(frame)), *[frame[c] for c in names],
                            frame.g == "b", frame.g == "c"]).astype(float)


TERMS = [Numeric("x"), Numeric("z"), Factor("g")]


def test_tails_match_tables():
    assert t_two_sided(2.0, 10) == pytest.approx(0.0733880347707404, abs=1e-12)
    assert t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert f_tail(3.0, 2, 20) == pytest.approx((1 + 3.0 * 2 / 20) ** -10, abs=1e-12)
    assert chi2_tail(5.991464547, 2) == pytest.approx(math.exp(-5.991464547 / 2), abs=1e-12)
    assert chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)


def test_levels_and_reference(spark):
    df = spark.createDataFrame([("WR",), ("TE",), ("RB",), (None,)], "p string")
    assert Design.learn(df, [Factor("p", ref="WR")]).levels == {"p": ["WR", "RB", "TE"]}
    numbers = spark.createDataFrame([(10,), (9,), (1,)], "p int")
    assert Design.learn(numbers, [Factor("p")]).levels == {"p": ["1", "9", "10"]}


def test_unseen_level_and_null_give_null(spark, rows_of):
    design = Design.learn(spark.createDataFrame([("a",), ("b",)], "g string"), [Factor("g")])
    df = spark.createDataFrame([("a",), ("b",), ("q",), (None,)], "g string")
    assert rows_of(df.select("g", design.columns()["gb"])) == [(None, None), ("a", 0.0), ("b", 1.0), ("q", None)]


def test_cross_products_do_not_depend_on_partitions(spark, frame):
    df = spark.createDataFrame(frame)
    columns = {"1": F.lit(1.0), "x": F.col("x"), "y": F.col("y")}
    one = cross_products(df.repartition(1), columns)[0]
    many = cross_products(df.repartition(7), columns)[0]
    parts = cross_products(df, columns, by=F.col("id") % 3)
    m = np.column_stack([np.ones(len(frame)), frame.x, frame.y])
    assert one == pytest.approx(m.T @ m)
    assert many == pytest.approx(one)
    assert sum(parts.values()) == pytest.approx(one)


def test_linear_fit_matches_numpy_and_spark_ml(spark, frame):
    df = spark.createDataFrame(frame)
    fit = fit_linear(df, F.col("y"), TERMS)
    x = dense(frame)
    beta = np.linalg.lstsq(x, frame.y, rcond=None)[0]
    assert fit.names == ["(Intercept)", "x", "z", "gb", "gc"]
    assert fit.beta == pytest.approx(beta)
    features = [F.col("x"), F.col("z"), (F.col("g") == "b").cast("double").alias("b"),
                (F.col("g") == "c").cast("double").alias("c")]
    ready = VectorAssembler(inputCols=["x", "z", "b", "c"], outputCol="f").transform(df.select("y", *features))
    model = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(ready)
    table = {r["term"]: r for r in fit.summary(spark).collect()}
    assert table["x"]["std_error"] == pytest.approx(model.summary.coefficientStandardErrors[0])
    assert table["gc"]["p_value"] == pytest.approx(model.summary.pValues[3], abs=1e-9)
    assert fit.r2 == pytest.approx(model.summary.r2)
    stats = fit.fit_statistics(spark).first()
    assert stats["n"] == 400 and 0 <= stats["p_value"] < 1e-6


def test_repeated_column_is_dropped(spark, frame):
    df = spark.createDataFrame(frame).withColumn("x2", 3 * F.col("x"))
    fit = fit_linear(df, F.col("y"), [Numeric("x"), Numeric("x2"), Numeric("z")])
    assert fit.dropped == ["x2"]
    assert fit.names == ["(Intercept)", "x", "z"]
    assert predict(df, fit, "p").filter(F.col("p").isNull()).count() == 0


def test_rows_with_nulls_are_left_out_but_scored_null(spark, frame):
    holed = frame.copy()
    holed.loc[:9, "x"] = np.nan
    df = spark.createDataFrame(holed).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    fit = fit_linear(df, F.col("y"), TERMS)
    assert fit.rows == 390
    assert predict(df, fit, "p").filter(F.col("p").isNull()).count() == 10


def test_breusch_pagan_and_hc3(spark, frame):
    df = spark.createDataFrame(frame)
    fit = fit_linear(df, F.col("y"), TERMS)
    x = dense(frame)
    residual = frame.y.to_numpy() - x @ fit.beta
    e2 = residual ** 2
    aux = e2 - x @ np.linalg.lstsq(x, e2, rcond=None)[0]
    statistic = len(x) * (1 - aux @ aux / ((e2 - e2.mean()) ** 2).sum())
    test = breusch_pagan(df, F.col("y"), fit)
    assert test["statistic"] == pytest.approx(statistic)
    assert test["df"] == 4 and test["p_value"] == pytest.approx(chi2_tail(statistic, 4))
    inverse = np.linalg.inv(x.T @ x)
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    meat = (x * (residual / (1 - h))[:, None]).T @ (x * (residual / (1 - h))[:, None])
    assert robust_covariance(df, F.col("y"), fit) == pytest.approx(inverse @ meat @ inverse)


def test_derived_terms_are_shared_by_fit_and_scoring(spark, frame):
    df = spark.createDataFrame(frame)
    fit = fit_linear(df, F.asinh("y"), [Numeric("ax", "asinh(x)")])
    x = np.column_stack([np.ones(len(frame)), np.arcsinh(frame.x)])
    beta = np.linalg.lstsq(x, np.arcsinh(frame.y), rcond=None)[0]
    assert fit.beta == pytest.approx(beta)
    scored = predict(df, fit, "p").orderBy("id").toPandas().p.to_numpy()
    assert scored == pytest.approx(x @ beta)
    assert breusch_pagan(df, F.asinh("y"), fit)["df"] == 1


def test_logistic_fit_solves_the_score_equations(spark, frame):
    df = spark.createDataFrame(frame)
    fit = fit_logistic(df, F.col("hit"), TERMS)
    x = dense(frame)
    beta = np.array([fit.beta[n] for n in ["(Intercept)", "x", "z", "gb", "gc"]])
    p = 1 / (1 + np.exp(-x @ beta))
    assert x.T @ (frame.hit - p) == pytest.approx(np.zeros(5), abs=1e-5)
    information = x.T @ (x * (p * (1 - p))[:, None])
    assert fit.errors["x"] == pytest.approx(math.sqrt(np.linalg.inv(information)[1, 1]), rel=1e-4)
    scored = score_logistic(df, fit).orderBy("id").toPandas()
    assert scored.probability.to_numpy() == pytest.approx(p, abs=1e-8)


def test_rmse_and_trend(spark, frame):
    df = spark.createDataFrame(frame)
    assert rmse(df, "x", "z").first()["rmse"] == pytest.approx(math.sqrt(((frame.x - frame.z) ** 2).mean()))
    line = trend_line(df, "x", "y").first()
    slope, intercept = np.polyfit(frame.x, frame.y, 1)
    assert (line["slope"], line["intercept"]) == pytest.approx((slope, intercept))
    residual = frame.y - intercept - slope * frame.x
    assert line["sigma"] == pytest.approx(math.sqrt((residual ** 2).sum() / 398))


def test_split_takes_the_share_of_every_bin(spark, frame):
    df = spark.createDataFrame(frame)
    split = stratified_split(df, "y", ["id"], 0.7, 123)
    again = stratified_split(df.repartition(5), "y", ["id"], 0.7, 123)
    assert split.exceptAll(again).count() == 0
    out = split.toPandas()
    bins = pd.cut(out.y, np.quantile(out.y, [0, .25, .5, .75, 1]), include_lowest=True)
    for _, part in out.groupby(bins, observed=True):
        assert part.in_train.sum() == math.ceil(round(0.7 * len(part), 9))


def test_split_with_merged_cut_points(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 80 else float(i)) for i in range(100)], "id int, y double")
    out = stratified_split(df, "y", ["id"]).toPandas()  # the quartiles are 0: one bin is left
    assert out.in_train.sum() == 70


def test_cross_validated_subsets_match_refits(spark, frame):
    df = spark.createDataFrame(frame)
    search = cv_backward_subset(df, F.col("y"), TERMS, ["id"], sizes=[1, 2, 3, 4], folds=5, seed=9)
    folds = df.select("id", fold_of(["id"], 9, 5).alias("f")).orderBy("id").toPandas().f.to_numpy()
    x, y = dense(frame), frame.y.to_numpy()

    def backward(rows, size):
        active = list(range(5))
        while len(active) > size + 1:
            def loss(j):
                kept = [k for k in active if k != j]
                b = np.linalg.lstsq(x[rows][:, kept], y[rows], rcond=None)[0]
                return ((y[rows] - x[rows][:, kept] @ b) ** 2).sum()
            active.remove(min(active[1:], key=loss))
        return active, np.linalg.lstsq(x[rows][:, active], y[rows], rcond=None)[0]

    results = {r["nvmax"]: r for r in search.results.collect()}
    for size in (1, 2, 4):
        errors, absolute, r2 = [], [], []
        for f in range(5):
            active, b = backward(folds != f, size)
            p = x[folds == f][:, active] @ b
            errors.append(math.sqrt(((y[folds == f] - p) ** 2).mean()))
            absolute.append(np.abs(y[folds == f] - p).mean())
            r2.append(np.corrcoef(p, y[folds == f])[0, 1] ** 2)
        assert results[size]["rmse"] == pytest.approx(np.mean(errors))
        assert results[size]["rmse_sd"] == pytest.approx(np.std(errors, ddof=1))
        assert results[size]["mae"] == pytest.approx(np.mean(absolute))
        assert results[size]["r2"] == pytest.approx(np.mean(r2))
    assert search.best_size == min(results, key=lambda k: results[k]["rmse"])
    chosen = {r["term"] for r in search.chosen.filter("nvmax = 2 AND included").collect()}
    assert chosen == {"x", "z"}
