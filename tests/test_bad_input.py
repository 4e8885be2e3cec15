"""Large offsets, NaN, null outcomes and malformed ids."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from yardframe.functions.nulls import without_nulls
from yardframe.functions.text import decode_id
from yardframe.models.design import Numeric
from yardframe.models.linear import fit_linear
from yardframe.models.resample import stratified_split
from yardframe.operators.cutpoints import quantiles
from yardframe.operators.rows import dense_rank_within


def test_predictor_with_large_offset_keeps_its_slope(spark):
    rng = np.random.default_rng(3)
    x = 1e9 + rng.normal(0, 1e3, 2000)
    y = 2.5 * (x - 1e9) + rng.normal(0, 1, 2000)
    fit = fit_linear(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), F.col("y"), [Numeric("x")])
    assert fit.dropped == []
    assert fit.beta[1] == pytest.approx(np.polyfit(x - 1e9, y, 1)[0], rel=1e-9)


def test_error_variance_with_a_large_mean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 2000)
    y = 1e6 + 1e-3 * x + 1e-3 * rng.normal(0, 1, 2000)
    fit = fit_linear(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), F.col("y"), [Numeric("x")])
    z = y - 1e6
    slope, start = np.polyfit(x, z, 1)
    rss = ((z - start - slope * x) ** 2).sum()
    assert fit.sigma2 == pytest.approx(rss / 1998, rel=1e-6)
    assert fit.r2 == pytest.approx(1 - rss / ((z - z.mean()) ** 2).sum(), rel=1e-6)
    errors = np.sqrt(np.diag(fit.covariance()))
    dense = np.column_stack([np.ones(2000), x])
    assert errors == pytest.approx(np.sqrt(np.diag(rss / 1998 * np.linalg.inv(dense.T @ dense))), rel=1e-6)


def test_nan_is_no_value(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "id int, v double")
    assert quantiles(df, "v", [0.5]) == [2.0]
    assert without_nulls(df, ["v"]).count() == 2


def test_split_keeps_rows_without_an_outcome(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 10 == 0, float("nan"))
                                 .otherwise(F.col("id").cast("double")).alias("v"))
    split = stratified_split(df, "v", ["id"])
    assert split.where("in_train").count() + split.where("not in_train").count() == 100
    assert split.where("in_train and (v is null or isnan(v))").count() == 0


def test_malformed_ids_stay(spark):
    plain = "00-0031234"
    coded = "xxxx" + plain.encode().hex() + "0000"
    ids = ["ffffffff-ffff-ffff-ffff-ffffffffffff", "zzzzzzzz-zzzz-zzzz-zzzz-zzzzzzzzzzzz", coded, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "i int, id string")
    got = [r[0] for r in df.orderBy("i").select(decode_id("id")).collect()]
    assert got == ids  # the third has no 36 characters


def test_null_has_no_rank(spark):
    df = spark.createDataFrame([("a", 5), ("a", 3), ("a", None), ("b", None)], "g string, v int")
    got = {(r["g"], r["v"]): r["rank"] for r in dense_rank_within(df, "g", "v", "rank").collect()}
    assert got == {("a", 5): 1, ("a", 3): 2, ("a", None): None, ("b", None): None}
