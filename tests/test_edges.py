"""Ordinary input at the edges: zero divisors, fine steps, constants, large shapes, forced paths."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcohort.functions.special import gamma_cdf_array
from gridcohort.operators.attribution import birth_ratio
from gridcohort.operators.features import add_group_share
from gridcohort.operators.grid import regrid
from gridcohort.operators.joins import nearest_cell
from gridcohort.operators.quality import density_table
from gridcohort.operators.quantiles import grouped_quantiles, many_quantiles, quantile_bin
from gridcohort.operators.results import coefficient_view, harmonize_extremes, significance_summary


def test_gamma_of_large_shapes():
    a = np.array([1e3, 9e3, 1e4, 1e6, 1e8, 1e10])
    # P(a, a) = 1/2 + 1/(3 sqrt(2 pi a)) + O(a^-3/2)
    near = 0.5 + 1 / (3 * np.sqrt(2 * np.pi * a)) + 1 / (540 * np.sqrt(2 * np.pi) * a**1.5)
    np.testing.assert_allclose(gamma_cdf_array(a, a), near, atol=1e-8)
    # the recurrence P(a, x) - P(a + 1, x) = x^a e^-x / Gamma(a + 1) across the change of method
    for x in (9_700.0, 9_999.0, 10_001.0, 10_300.0):
        low, high = gamma_cdf_array(np.array([9_999.5, 10_000.5]), np.array([x, x]))
        step = math.exp(9_999.5 * math.log(x) - x - math.lgamma(10_000.5))
        assert abs(low - high - step) < 1e-9
    for z in (-3, -1, 1, 3):  # skew-corrected normal limit
        a = np.array([1e8])
        got = gamma_cdf_array(a, a + z * np.sqrt(a))[0]
        density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        assert abs(got - (0.5 * math.erfc(-z / math.sqrt(2)) - density * (z * z - 1) / (3 * 1e4))) < 1e-7
    assert gamma_cdf_array(np.array([2.0, 1e5]), np.array([np.inf, np.inf])).tolist() == [1.0, 1.0]


def test_zero_divisors_give_null(spark):
    coefs = spark.createDataFrame([("a", 1.0, 0.0), ("a", 3.0, 1.0)], "spec_id string, coef double, se double")
    row = significance_summary(coefs, ["spec_id"], set_by=["spec_id"]).first()
    assert row["estimates"] == 2 and row["p01_pos"] == 1
    shares = add_group_share(spark.createDataFrame([("a", 0, 0)], "g string, x long, total long"), ["g"], ["x"], "total")
    assert shares.first()["set_x_share"] is None
    rows = [(1, 2000, 49, 0.0), (1, 2000, 47, 5.0), (2, 2000, 49, 10.0), (2, 2000, 47, 5.0)]
    out = {r["LocationId"]: r["born_ratio"] for r in birth_ratio(spark.createDataFrame(rows, "LocationId int, Time int, IndicatorId int, Value double")).collect()}
    assert out == {1: None, 2: 0.5}


def test_a_step_of_a_tenth(spark):
    nodes = spark.createDataFrame([(i / 10, 0.3, float(i)) for i in range(1, 10)], "lat double, lon double, v double")
    points = spark.createDataFrame([(i, 0.1 * i + 0.01, 0.3) for i in range(1, 10)], "id int, lat double, lon double")
    assert {r["id"]: r["v"] for r in nearest_cell(points, nodes, 0.1).collect()} == {i: float(i) for i in range(1, 10)}
    grid = nodes.select("lat", "lon", "v", F.lit(1).alias("month")).unionByName(nodes.select("lat", F.lit(0.4).alias("lon"), (F.col("v") * 2).alias("v"), F.lit(1).alias("month")))
    targets = spark.createDataFrame([(0.1 + 0.2, 0.3), (0.35, 0.4)], "lat double, lon double")
    out = {round(r["lat"], 2): r["v"] for r in regrid(grid, targets, ["v"], 0.1).collect()}
    assert out[0.3] == pytest.approx(3.0) and out[0.35] == pytest.approx(7.0)


def test_density_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, float(i), None) for i in range(10)], "a double, b double, c double")
    out = density_table(df, ["a", "b", "c"], 0.0, 9.0, 5).toPandas()
    assert out.groupby("column").size().to_dict() == {"a": 5, "b": 5, "c": 5}
    assert out.loc[out["column"] != "b", "density"].isna().all() and out.loc[out["column"] == "b", "density"].notna().all()


def test_views_keep_small_samples_by_default(spark):
    rows = [("s", "o", 1, "stdm_t_born_1m_b_avg_pos_int", 1.0, 0.1, 50, "g", "v")]
    coefs = spark.createDataFrame(rows, "spec_id string, outcome string, cell_level int, term string, coef double, se double, n long, group_var string, group_value string")
    assert coefficient_view(coefs, "model").count() == coefficient_view(coefs, "window").count() == coefficient_view(coefs, "horserace").count() == 1
    assert coefficient_view(coefs, "heterogeneity").count() == 0 and coefficient_view(coefs, "heterogeneity", min_n=50).count() == 1


def test_only_prefixes_are_harmonised(spark):
    names = ["hd35_x", "fd_x", "spi1_fd_hd_x", "child_fid_x"]
    out = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(harmonize_extremes("t")).collect()]
    assert out == ["t_x_pos_int", "t_x_neg_int", "spi1_fd_hd_x", "child_fid_x"]


@pytest.mark.parametrize("small", [3, 100_000])
def test_quantiles_by_either_way(spark, small):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 900), "x": rng.normal(size=900).round(2), "y": rng.integers(0, 50, 900).astype(float)})
    pdf.loc[pdf["g"] == 3, "x"] = None
    df = spark.createDataFrame(pdf).withColumns({"g": F.when(F.col("g") > 0, F.col("g")), "x": F.when(~F.isnan("x"), F.col("x"))}).repartition(7)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    out = many_quantiles(df, {"x": F.col("x"), "y": F.col("y"), "none": F.lit(None)}, probs, small)
    np.testing.assert_allclose(out["x"], pdf["x"].quantile(probs))
    np.testing.assert_allclose(out["y"], pdf["y"].quantile(probs))
    assert all(math.isnan(v) for v in out["none"])
    got = {r["g"]: r["edges"] for r in grouped_quantiles(df, "x", probs, ["g"], small).collect()}
    assert set(got) == {None, 1, 2}
    for g, edges in got.items():
        np.testing.assert_allclose(edges, pdf[pdf["g"] == (g or 0)]["x"].quantile(probs))
    bins = quantile_bin(df.filter("x IS NOT NULL"), "x", 4, "b", ["g"], small).filter("g = 1").toPandas()
    want = pd.qcut(bins["x"], 4, labels=False) + 1
    assert (bins["b"] == want).all()
