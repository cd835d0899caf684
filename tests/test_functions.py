import math

import numpy as np
import pandas as pd
import pytest

from gridcohort.functions import columns as c
from gridcohort.functions.special import gamma_cdf, gamma_cdf_array, log_gamma_array, normal_quantile


def values(spark, data, expr, typ="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, x {typ}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_snap_cases(spark):
    assert values(spark, [1.3, 1.62, 3.9, 2.05, 5.78, 3.0], c.snap("x", 0.25)) == [1.25, 1.5, 4.0, 2.0, 5.75, 3.0]
    assert values(spark, [1.3, 2.6, 3.0, 2.5], c.snap("x", 0.5, 0.25)) == [1.25, 2.75, 3.25, 2.25]
    data = np.random.default_rng(0).uniform(-180, 180, 300).tolist() + [0.125, 0.375, -0.125, 0.5, 1.5]
    assert values(spark, data, c.snap("x", 0.25)) == [round(v * 4) / 4 for v in data]


def test_nan_is_missing(spark):
    assert values(spark, [1.0, math.nan, None], c.nan_to_null("x")) == [1.0, None, None]
    pos, neg = c.sign_flags("x")
    assert values(spark, [1.0, 0.0, -1.0, None], pos) == [True, True, False, False]
    assert values(spark, [1.0, 0.0, -1.0, None], neg) == [False, True, True, False]
    assert values(spark, [1.0, 0.0, -1.0, None], c.positive_part("x")) == [1.0, 0.0, 0.0, None]
    assert values(spark, [1.0, 0.0, -1.0, None], c.negative_part("x")) == [0.0, 0.0, -1.0, None]


def test_century_months(spark):
    assert values(spark, [1201, 1200, 1, 12], c.century_month_year("x"), "int") == [2000, 1999, 1900, 1900]
    assert values(spark, [1201, 1200, 1, 12], c.century_month_month("x"), "int") == [1, 12, 1, 12]


def test_interval_bins_match_cut(spark):
    data = [0.0, 0.5, 7.0, 7.1, 13.0, 35.0, 36.0, -1.0]
    edges, labels = [0, 7, 13, 35, np.inf], ["a", "b", "c", "d"]
    for right in (True, False):
        got = values(spark, data + [None], c.interval_bin("x", edges, labels, right))
        want = [None if pd.isna(v) else v for v in pd.cut(pd.Series(data + [np.nan]), edges, labels=labels, right=right)]
        assert got == want


def test_nearest_bucket_ties_to_the_earlier(spark):
    years = [1999, 2002, 2003, 2020, 2050]
    want = [min((2000, 2005, 2010), key=lambda b: (abs(b - y), b)) for y in years]
    assert values(spark, years, c.nearest_bucket("x", (2000, 2005, 2010)), "int") == want


def test_natural_order(spark):
    names = ["z1.txt", "z10.txt", "z12.txt", "z2.txt", "file_1_a.log"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r[0] for r in df.orderBy(c.natural_key("x")).collect()]
    assert got == ["file_1_a.log", "z1.txt", "z2.txt", "z10.txt", "z12.txt"]


def test_printed_numbers(spark):
    assert values(spark, ["-1.369***", "(0.386)", "", " 2 "], c.number_text("x"), "string") == [-1.369, 0.386, None, 2.0]
    assert values(spark, ["-1.369***", "1"], c.stars("x"), "string") == [3, 0]


def test_log_gamma():
    x = np.array([0.05, 0.3, 1, 2.5, 30, 400.0])
    np.testing.assert_allclose(log_gamma_array(x), [math.lgamma(v) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("shape", [0.3, 1.0, 4.2, 30.0, 150.0])
def test_gamma_cdf_against_integration(shape):
    for at in (0.3, 0.9, 1.4):
        x = shape * at
        u = np.linspace(0, x ** min(shape, 1.0), 400_001)
        # Substitute t = u^(1/s), which takes the singularity at zero away for small shapes.
        s = min(shape, 1.0)
        t = u ** (1 / s)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.exp((shape - 1) * np.log(t) - t - math.lgamma(shape)) * t ** (1 - s) / s
        f[0] = 1 / math.gamma(shape) / s if shape <= 1 else 0.0
        want = np.trapezoid(f, u)
        assert abs(gamma_cdf_array(np.array([shape]), np.array([x]))[0] - want) < 1e-7


def test_gamma_cdf_column_keeps_nulls(spark):
    df = spark.createDataFrame([(2.0, 3.0), (None, 1.0), (2.0, None), (2.0, 0.0)], "a double, x double")
    got = [r[0] for r in df.select(gamma_cdf("a", "x")).collect()]
    assert got[1:] == [None, None, 0.0] and abs(got[0] - (1 - 4 * math.exp(-3))) < 1e-12


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 1 - 1e-6]
    got = values(spark, p + [0.0, 1.0], normal_quantile("x"))
    np.testing.assert_allclose(got[:-2], [NormalDist().inv_cdf(v) for v in p], rtol=2e-9, atol=1e-9)
    assert got[-2:] == [None, None]


def test_powers(spark):
    df = c.add_powers(spark.createDataFrame([(3,)], "a int"), ["a"])
    assert df.first().asDict() == {"a": 3, "a_squ": 9, "a_cub": 27}
    assert values(spark, [90061.0, 86399.0], c.whole_days("x")) == [1, 0]
    assert round(values(spark, [300.0], c.celsius("x"))[0], 2) == 26.85
    assert c.narrowest_type(0, 100, True) == "byte" and c.narrowest_type(-1, 40000, True) == "int"
