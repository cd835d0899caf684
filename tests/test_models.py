import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcohort.operators.results import coefficient_view, confidence_bounds, flip_sign, harmonize_extremes, zero_nonsignificant
from gridcohort.plans.specs import ModelSpec, required_columns, run_specs, shock_group, survivor_models, terms
from test_regression import dummies_ols

PERIODS = ("inutero", "born_1m6m", "born_6m12m")


def records(rows=2500, seed=11):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"cell": rng.integers(0, 8, rows), "month": rng.integers(1, 13, rows), "year": rng.integers(1996, 2004, rows)})
    for var in ("spi1", "stdm_t"):
        for p in PERIODS:
            pdf[f"{var}_{p}_b_avg"] = rng.normal(size=rows)
    for var in ("hd35", "fd"):
        for p in PERIODS:
            pdf[f"{var}_{p}_b_avg"] = rng.integers(0, 25, rows).astype(float)
    age = rng.integers(0, 40, rows)
    pdf["d_biannual_1m6m"] = np.where(age < 6, 1000, 0)
    pdf["d_biannual_6m12m"] = np.where((age >= 6) & (age < 12), 1000, 0)
    pdf["rural"] = rng.integers(0, 2, rows).astype(float)
    pdf["big"] = pdf["cell"] // 3
    pdf["zone"] = np.where(rng.random(rows) < 0.5, "wet", "dry")
    return pdf


def spec(**changes):
    base = dict(periods=PERIODS, controls=("rural",), cells=("cell", "big"), month="month", year="year", age="d")
    return ModelSpec(**(base | changes))


def design(pdf, family, period):
    out = {}
    for var in ("spi1", "stdm_t"):
        name = f"{var}_{period}_b_avg"
        x = pdf[name].to_numpy()
        if family == "signs":
            out |= {f"{name}_neg_int": np.minimum(x, 0), f"{name}_pos_int": np.maximum(x, 0)}
        elif family == "quadratic":
            out |= {name: x, f"{name}_sq": x * x}
        else:
            out |= {name: x}
    return out


@pytest.mark.parametrize("family", ["signs", "quadratic"])
def test_survivor_models_equal_separate_regressions(spark, family):
    pdf = records()
    chosen = spec() if family == "signs" else spec(family="quadratic", signs=False)
    out = survivor_models(spark.createDataFrame(pdf).repartition(5), chosen).toPandas()
    sample = pdf
    x = design(pdf, family, "inutero")
    for period in PERIODS[1:]:
        x |= design(pdf, family, period)
        outcome = chosen.outcome(period)
        for level, cell in enumerate(("cell", "big"), 1):
            part = pd.DataFrame(x).loc[sample.index].assign(
                rural=sample["rural"], y=sample[outcome], cell=sample[cell], month=sample["month"], year=sample["year"]
            )
            xs = [*x, "rural"]
            beta, se, r2 = dummies_ols(part, xs)
            got = out[(out["outcome"] == outcome) & (out["cell_level"] == level)].set_index("term")
            assert set(got.index) == set(xs) and (got["n"] == len(part)).all()
            np.testing.assert_allclose(got.loc[xs, "coef"], beta, rtol=1e-6, atol=1e-8)
            np.testing.assert_allclose(got.loc[xs, "se"], se, rtol=1e-6)
            np.testing.assert_allclose(got["r2"], r2, rtol=1e-6)
        sample = sample[sample[outcome] == 0]


def test_groups_and_families(spark):
    pdf = records(1200)
    df = spark.createDataFrame(pdf)
    specs = [spec(family="spline", cells=("cell",)), spec(family="extremes", cells=("cell",), binned=True), spec(family="horserace", cells=("cell",))]
    out = run_specs(df, specs).toPandas()
    counts = out.groupby(["spec_id", "outcome"]).size().unstack()
    assert counts.loc[specs[0].spec_id].tolist() == [17, 25]
    assert counts.loc[specs[1].spec_id].tolist() == [2 * 8 + 1, 3 * 8 + 1]
    assert counts.loc[specs[2].spec_id].tolist() == [2 * 6 + 1, 3 * 6 + 1]


@pytest.mark.parametrize("family,signs,cut", [("linear", True, "quartile"), ("quadratic", True, "quartile"), ("spline", True, "quartile"), ("spline", True, "sd"), ("extremes", True, "quartile"), ("horserace", True, "quartile")])
def test_a_group_is_fitted_as_if_alone(spark, family, signs, cut):
    df = spark.createDataFrame(records(1200))
    one = spec(family=family, signs=signs, cut=cut, cells=("cell",))
    grouped = run_specs(df, [one], "zone").toPandas()
    for value in ("wet", "dry"):
        alone = survivor_models(df.filter(F.col("zone") == value), one).toPandas()
        merged = grouped[grouped["group_value"] == value].merge(alone, on=["outcome", "term"])
        assert len(merged) == len(alone) and len(alone)
        np.testing.assert_allclose(merged["coef_x"], merged["coef_y"], rtol=1e-6, atol=1e-7)


def test_spline_limits_come_from_the_sample_before(spark):
    """The second period's limits still see the events of the first period."""
    pdf = records(2500)
    one = spec(family="spline", cells=("cell",))
    out = survivor_models(spark.createDataFrame(pdf), one).toPandas()
    got = out[out["outcome"] == "d_biannual_6m12m"].set_index("term")
    made = {}
    for p in PERIODS:
        for var in ("spi1", "stdm_t"):
            name = f"{var}_{p}_b_avg"
            x = pdf[name]
            low, mid, high = (x.quantile(q) for q in (0.25, 0.5, 0.75))
            for q, hit in (("q1", x < low), ("q2", (x >= low) & (x <= mid)), ("q3", (x > mid) & (x <= high)), ("q4", x > high)):
                made[f"{name}_{q}_int"] = x.where(hit, 0.0)
    part = pd.DataFrame(made).assign(rural=pdf["rural"], y=pdf["d_biannual_6m12m"], cell=pdf["cell"], month=pdf["month"], year=pdf["year"])
    part = part[pdf["d_biannual_1m6m"] == 0]
    xs = [*made, "rural"]
    beta, se, _ = dummies_ols(part, xs)
    np.testing.assert_allclose(got.loc[xs, "coef"], beta, rtol=1e-6, atol=1e-7)
    np.testing.assert_allclose(got.loc[xs, "se"], se, rtol=1e-6)


def test_a_column_without_values_drops_out(spark):
    pdf = records(600)
    one = spec(family="spline", cells=("cell",), drought="spi1")
    df = spark.createDataFrame(pdf).withColumn(one.exposure("spi1", one.steps[0]), F.lit(None).cast("double"))
    for group in (None, "zone"):
        out = run_specs(df, [one], group).filter(F.col("outcome") == one.outcome(one.steps[0])).toPandas()
        empty = out["term"].str.startswith(one.exposure("spi1", one.steps[0]))
        assert out.loc[empty, "coef"].isna().all() and out.loc[~empty, "coef"].notna().all() and (out["n"] > 0).all()


def test_wide_specification_plans_quickly(spark):
    """A plain filter per column; one filter over all columns made planning time explode."""
    pdf = records(600)
    many = [f"c{i}" for i in range(40)]
    rng = np.random.default_rng(1)
    pdf = pd.concat([pdf, pd.DataFrame(rng.normal(size=(600, 40)), columns=many)], axis=1)
    out = survivor_models(spark.createDataFrame(pdf), spec(controls=tuple(many), family="quadratic", signs=False, cells=("cell",)))
    assert out.count() == (8 + 40) + (12 + 40)


def test_missing_columns_are_named():
    with pytest.raises(ValueError, match="hd35_inutero_b_avg"):
        required_columns(spec(family="extremes"), ["spi1_inutero_b_avg"])
    assert list(terms(spec(signs=False), "inutero")) == ["spi1_inutero_b_avg", "stdm_t_inutero_b_avg"]
    assert spec(periods=("born_3m6m",), age_scheme="inutero").outcome("born_3m6m") == "d_quarterly_3m6m"


def test_shock_group_limits(spark):
    pdf = records(500)
    pdf.loc[:9, "stdm_t_inutero_b_avg"] = None
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("stdm_t_inutero_b_avg"), F.col("stdm_t_inutero_b_avg")))
    out = shock_group(df, "x").toPandas()
    lo, hi = pdf["stdm_t_inutero_b_avg"].quantile([0.15, 0.85])
    want = ((pdf["stdm_t_inutero_b_avg"] < lo) | (pdf["stdm_t_inutero_b_avg"] > hi)).sum()
    assert out["shock"].sum() == want and not out["shock"].isna().any()


def test_bounds_zeroing_and_names(spark):
    df = spark.createDataFrame([("hd35_born_1m6m_b_avg", 1.0, 0.2), ("fd_inutero_b_avg", 0.1, 0.2), ("stdm_t_x", -3.0, None)], "term string, coef double, se double")
    out = {r["term"]: r for r in zero_nonsignificant(confidence_bounds(df, 2.042)).withColumn("h", harmonize_extremes("term")).collect()}
    assert out["hd35_born_1m6m_b_avg"]["significant"] and abs(out["hd35_born_1m6m_b_avg"]["lower"] - (1 - 0.4084)) < 1e-12
    assert out["fd_inutero_b_avg"]["coef"] == 0.0 and out["stdm_t_x"]["coef"] == -3.0
    assert out["hd35_born_1m6m_b_avg"]["h"] == "t_born_1m6m_b_avg_pos_int" and out["fd_inutero_b_avg"]["h"] == "t_inutero_b_avg_neg_int"
    flipped = flip_sign(confidence_bounds(df), F.col("term") == "hd35_born_1m6m_b_avg").first()
    assert flipped["coef"] == -1.0 and flipped["lower"] < flipped["upper"]


def test_window_view_and_sample_gate(spark, tmp_path):
    from gridcohort.plans.specs import write_coefficients

    rows = [("s", "o", 1, f"stdm_t_born_1m_b_w{k}_pos_int", float(k), 0.1, 200_000) for k in (1, 2, 10)]
    rows.append(("s", "o", 1, "stdm_t_born_1m_b_w3_pos_int", 3.0, 0.1, 99_999))
    coefs = spark.createDataFrame(rows, "spec_id string, outcome string, cell_level int, term string, coef double, se double, n long")
    out = coefficient_view(coefs, "window", min_n=100_000).orderBy("coef").collect()
    assert [(r["window"], r["key"]) for r in out] == [(f"w{k}", "born_1m_b_pos_int") for k in (1, 2, 10)]
    write_coefficients(coefs, str(tmp_path / "c"), order=["stdm_t_born_1m_b_w2_pos_int"])
    back = spark.read.parquet(str(tmp_path / "c"))
    assert back.count() == 4 and back.filter("term_order = 1").count() == 1
