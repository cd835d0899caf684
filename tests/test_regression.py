import numpy as np
import pandas as pd
import pytest

from gridcohort.operators.regression import fe_ols


def sample(rows=1500, cells=12, k=2, seed=3, hot=False):
    rng = np.random.default_rng(seed)
    cell = rng.integers(0, cells, rows)
    if hot:
        cell[: rows // 2] = 0
    pdf = pd.DataFrame({"cell": cell, "month": rng.integers(1, 13, rows), "year": rng.integers(1995, 2010, rows)})
    for i in range(k):
        pdf[f"x{i}"] = rng.normal(size=rows) + 0.3 * pdf["month"] + 0.1 * cell
    pdf["y"] = 2 * pdf["x0"] - (pdf["x1"] if k > 1 else 0) + 0.2 * (pdf["year"] - 2000) * cell + rng.normal(size=rows) * 3
    pdf["g"] = np.where(rng.random(rows) < 0.4, "a", "b")
    return pdf


def dummies_ols(pdf, xs, trend="linear"):
    """Least squares with one dummy per (cell, month) and one slope per cell, clustered by cell."""
    y = pdf["y"].to_numpy(float)
    x = pdf[xs].to_numpy(float)
    effects = pd.get_dummies(pdf["cell"].astype(str) + "-" + pdf["month"].astype(str)).to_numpy(float)
    year = (pdf["year"] - 2000).to_numpy(float)
    by_cell = pd.get_dummies(pdf["cell"].astype(str)).to_numpy(float)
    parts = [effects]
    if trend != "none":
        parts.append(by_cell * year[:, None])
    if trend == "quadratic":
        parts.append(by_cell * (year**2)[:, None])
    z = np.hstack(parts)
    res = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    xt, yt = res(x), res(y)
    beta = np.linalg.lstsq(xt, yt, rcond=None)[0]
    e = yt - xt @ beta
    inv = np.linalg.inv(xt.T @ xt)
    scores = np.array([(xt[m] * e[m][:, None]).sum(0) for m in (pdf["cell"].to_numpy() == c for c in pdf["cell"].unique())])
    g, n, k = len(scores), len(y), len(xs)
    v = inv @ scores.T @ scores @ inv * g / (g - 1) * (n - 1) / (n - k)
    r2 = 1 - (e @ e) / ((y - y.mean()) ** 2).sum()
    return beta, np.sqrt(np.diag(v)), r2


def check(out, pdf, xs, trend="linear"):
    beta, se, r2 = dummies_ols(pdf, xs, trend)
    got = out.set_index("term").loc[xs]
    np.testing.assert_allclose(got["coef"], beta, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(got["se"], se, rtol=1e-6)
    np.testing.assert_allclose(got["r2"], r2, rtol=1e-7)
    assert (got["n"] == len(pdf)).all() and (got["n_clusters"] == pdf["cell"].nunique()).all()


@pytest.mark.parametrize("trend", ["none", "linear", "quadratic"])
@pytest.mark.parametrize("limit", [10, 0])
def test_matches_dummy_variables(spark, trend, limit):
    pdf = sample()
    out = fe_ols(spark.createDataFrame(pdf), "y", ["x0", "x1"], "cell", "month", "year", trend, native_limit=limit)
    check(out.toPandas(), pdf, ["x0", "x1"], trend)


def test_many_regressors_hot_cell(spark):
    pdf = sample(3000, k=14, hot=True)
    xs = [f"x{i}" for i in range(14)]
    out = fe_ols(spark.createDataFrame(pdf).repartition(6), "y", xs, "cell", "month", "year")
    check(out.toPandas(), pdf, xs)


@pytest.mark.parametrize("limit", [10, 0])
def test_groups_in_one_job(spark, limit):
    pdf = sample()
    out = fe_ols(
        spark.createDataFrame(pdf), "y", ["x0", "x1"], "cell", "month", "year", group=["g"], native_limit=limit
    ).toPandas()
    for g, part in pdf.groupby("g"):
        check(out[out["g"] == g], part, ["x0", "x1"])


@pytest.mark.parametrize("limit", [10, 0])
def test_collinear_term_has_no_coefficient(spark, limit):
    pdf = sample()
    pdf["twice"] = pdf["x0"] * 2
    df = spark.createDataFrame(pdf)
    out = fe_ols(df, "y", ["x0", "x1", "twice"], "cell", "month", "year", native_limit=limit).toPandas()
    assert out.set_index("term")["coef"].isna().to_dict() == {"x0": False, "x1": False, "twice": True}
    check(out, pdf, ["x0", "x1"])


@pytest.mark.parametrize("limit", [10, 0])
def test_nulls_leave_and_singletons_can(spark, limit):
    pdf = sample(400, cells=20)
    pdf.loc[::7, "x0"] = np.nan
    df = spark.createDataFrame(pdf)
    from gridcohort.functions.columns import clean_nans

    df = clean_nans(df, ["x0"])
    full = pdf.dropna()
    check(fe_ols(df, "y", ["x0", "x1"], "cell", "month", "year", native_limit=limit).toPandas(), full, ["x0", "x1"])
    many = full[full.groupby(["cell", "month"])["y"].transform("size") > 1]
    out = fe_ols(df, "y", ["x0", "x1"], "cell", "month", "year", drop_singletons=True, native_limit=limit).toPandas()
    assert (out["n"] == len(many)).all()
    np.testing.assert_allclose(out.set_index("term")["coef"].loc[["x0", "x1"]], dummies_ols(many, ["x0", "x1"])[0], rtol=1e-7)
