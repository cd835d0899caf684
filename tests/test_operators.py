import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridcohort.operators import cohort, exposure, features, grid, joins, quality, quantiles, spi


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# --- skew ------------------------------------------------------------------


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, no_broadcast, how):
    rng = np.random.default_rng(1)
    key = np.where(rng.random(5000) < 0.4, 7, rng.integers(0, 600, 5000))
    fact = frame(spark, pd.DataFrame({"id": range(5000), "k": key.astype("int32")}))
    lookup = frame(spark, pd.DataFrame({"k": np.arange(0, 500, dtype="int64"), "v": np.arange(500) * 2}))
    got = joins.skew_join(fact, lookup, ["k"], how)
    want = fact.join(lookup, ["k"], how)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_small_lookup_is_left_to_broadcast(spark):
    fact = spark.range(1000).withColumn("k", F.col("id") % 3)
    lookup = spark.range(3).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    assert "BroadcastHashJoin" in joins.skew_join(fact, lookup, ["k"])._jdf.queryExecution().executedPlan().toString()


def test_rank_within_hot_key(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(4000) * 3, "m": np.where(rng.random(4000) < 0.5, 1, rng.integers(0, 50, 4000))})
    pdf["t"] = rng.integers(0, 6, 4000)
    got = cohort.rank_within(frame(spark, pdf.sample(frac=1, random_state=1)), ["m"], ["t"], "id", "r").toPandas()
    want = pdf.sort_values("id").assign(r=lambda d: d.sort_values(["t", "id"]).groupby("m").cumcount() + 1)
    merged = got.merge(want, on="id")
    assert (merged["r_x"] == merged["r_y"]).all() and len(merged) == 4000


def test_dense_ids_are_consecutive(spark):
    df = spark.range(0, 3000, numPartitions=7).select((F.col("id") % 701).alias("a"), (F.col("id") % 3).alias("b"))
    out = cohort.dense_group_id(df, ["a", "b"], "n").distinct().orderBy("a", "b").toPandas()
    assert out["n"].tolist() == list(range(len(out)))


def test_dedupe_takes_the_first(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 2, "b"), (2, 9, "z"), (1, 2, "a")], "k int, o int, v string")
    assert sorted(map(tuple, joins.dedupe(df, ["k"], ["o"]).collect())) == [(1, 2, "a"), (2, 9, "z")]


def test_checked_join_raises(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="repeats"):
        joins.checked_join(left, twice, ["k"])
    assert joins.checked_join(left, twice, ["k"], "inner", "1:m").count() == 2


# --- nearest ---------------------------------------------------------------


@pytest.mark.parametrize("leaf", [64, 3])
def test_nearest_equals_brute_force(spark, leaf):
    rng = np.random.default_rng(5)
    left = pd.DataFrame({"id": range(300), "lon": rng.uniform(-2, 2, 300), "lat": rng.uniform(-2, 2, 300)})
    left.loc[250:, ["lon", "lat"]] = left.loc[0, ["lon", "lat"]].to_numpy()
    clump = rng.normal(0.55, 0.01, (200, 2))
    right = pd.DataFrame(np.vstack([rng.uniform(-2, 2, (150, 2)), clump]), columns=["lon", "lat"])
    right["right_id"] = range(len(right))
    right = pd.concat([right, right.iloc[:5].assign(right_id=[900, 901, 902, 903, 904])])
    out = joins.nearest_within(frame(spark, left), frame(spark, right), 0.3, leaf=leaf).toPandas().set_index("id")
    d = np.hypot(
        left["lon"].to_numpy()[:, None] - right["lon"].to_numpy(), left["lat"].to_numpy()[:, None] - right["lat"].to_numpy()
    )
    best = d.argmin(1)
    for i in range(300):
        if d[i].min() <= 0.3:
            assert out.loc[i, "right_id"] == right["right_id"].iloc[best[i]]
            assert abs(out.loc[i, "distance"] - d[i].min()) < 1e-12
        else:
            assert np.isnan(out.loc[i, "distance"])


# --- quantiles -------------------------------------------------------------


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy"])
def test_narrowed_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(6)
    x = {
        "normal": rng.normal(size=20000),
        "ties": np.where(rng.random(20000) < 0.4, 1.5, rng.normal(size=20000)),
        "heavy": np.exp(rng.normal(size=20000) * 8),
    }[shape]
    df = frame(spark, pd.DataFrame({"x": x})).repartition(4)
    probs = [0, 0.15, 0.25, 0.5, 0.75, 0.85, 1]
    got = quantiles.exact_quantiles(df, "x", probs, small=50)
    np.testing.assert_allclose(got, np.quantile(x, probs), rtol=1e-12)
    np.testing.assert_allclose(quantiles.exact_quantiles(df, "x", probs), np.quantile(x, probs), rtol=1e-12)


@pytest.mark.parametrize("small", [100_000, 40])
def test_quantile_bins_match_qcut(spark, small):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"i": range(900), "g": rng.integers(0, 3, 900), "x": rng.normal(size=900).round(2)})
    got = quantiles.quantile_bin(frame(spark, pdf), "x", 5, "b", small=small).toPandas().sort_values("i")
    assert (got["b"].to_numpy() == pd.qcut(pdf["x"], 5, labels=False).to_numpy() + 1).all()
    got = quantiles.quantile_bin(frame(spark, pdf), "x", 3, "b", ["g"], small=small).toPandas().sort_values("i")
    want = pdf.groupby("g")["x"].transform(lambda s: pd.qcut(s, 3, labels=False)) + 1
    # The last bit of an interpolated limit is not defined; only a value on a limit may differ.
    edges = pdf.groupby("g")["x"].quantile([1 / 3, 2 / 3]).unstack()
    off = pdf[got["b"].to_numpy() != want.to_numpy()]
    assert all(np.abs(edges.loc[r.g] - r.x).min() < 1e-12 for r in off.itertuples())


def test_repeated_edges_raise(spark):
    df = frame(spark, pd.DataFrame({"x": [1.0] * 50 + [2.0]}))
    with pytest.raises(ValueError, match="repeat"):
        quantiles.quantile_bin(df, "x", 3, "b")


# --- grid ------------------------------------------------------------------


def series(cells=4, months=60, seed=8):
    rng = np.random.default_rng(seed)
    idx = pd.MultiIndex.from_product([range(cells), pd.date_range("1995-01-01", periods=months, freq="MS")], names=["cell", "month"])
    pdf = pd.DataFrame({"v": rng.gamma(2.0, 10.0, len(idx)).round(3)}, index=idx).reset_index()
    pdf["month"] = pdf["month"].dt.date
    return pdf


def test_anomaly_moments(spark):
    df = grid.standardized_anomaly(frame(spark, series()), "v", "z", ["cell"])
    row = df.groupBy("cell", F.month("month")).agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).toPandas()
    assert abs(row["m"]).max() < 1e-9 and abs(row["s"] - 1).max() < 1e-9


def test_rolling_matches_pandas_and_respects_gaps(spark):
    pdf = series()
    out = grid.rolling_mean(frame(spark, pdf), "v", 6, "t", ["cell"])
    out = grid.rolling_mean(out, "v", 3, "c", ["cell"], centered=True).toPandas().sort_values(["cell", "month"])
    want = pdf.groupby("cell")["v"]
    np.testing.assert_allclose(out["t"], want.transform(lambda s: s.rolling(6).mean()), rtol=1e-9)
    np.testing.assert_allclose(out["c"], want.transform(lambda s: s.rolling(3, center=True).mean()), rtol=1e-9)
    gap = grid.rolling_sum(frame(spark, pdf.drop(index=10)), "v", 3, "s", ["cell"]).toPandas().sort_values(["cell", "month"])
    assert gap[gap["cell"] == 0]["s"].isna().sum() == 2 + 2


def test_anomaly_windows_share_one_exchange(spark):
    df = grid.anomalies(frame(spark, series()).repartition(3), "v", ["cell"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_spi_equals_direct_fit(spark):
    from statistics import NormalDist

    from gridcohort.functions.special import gamma_cdf_array

    pdf = series(cells=2, months=240)
    pdf.loc[pdf.index % 7 == 0, "v"] = 0.0
    out = spi.spi(frame(spark, pdf), "v", 1, calib=(1996, 2010), keys=["cell"]).toPandas().sort_values(["cell", "month"])
    pdf["year"] = [m.year for m in pdf["month"]]
    pdf["moy"] = [m.month for m in pdf["month"]]
    for (cell, moy), part in pdf.groupby(["cell", "moy"]):
        base = part[part["year"].between(1996, 2010)]["v"]
        pos = base[base > 0]
        a = np.log(pos.mean()) - np.log(pos).mean()
        shape = (1 + np.sqrt(1 + 4 * a / 3)) / (4 * a)
        q = (base == 0).mean()
        h = q + (1 - q) * gamma_cdf_array(np.full(len(part), shape), (part["v"] * shape / pos.mean()).to_numpy())
        want = [np.clip(NormalDist().inv_cdf(min(max(v, 1e-12), 1 - 1e-12)), -3.09, 3.09) for v in h]
        got = out[(out["cell"] == cell) & (out["month"].map(lambda m: m.month) == moy)]["spi1"]
        np.testing.assert_allclose(got, want, atol=1e-7)


def test_constant_series_has_no_index(spark):
    pdf = series(cells=1)
    pdf["v"] = 5.0
    assert spi.spi(frame(spark, pdf), "v", 1, keys=["cell"]).filter("spi1 IS NOT NULL").count() == 0
    assert spi.spi(frame(spark, pdf.assign(v=0.0)), "v", 1, keys=["cell"]).filter("spi1 IS NOT NULL").count() == 0


def test_gap_fill_is_linear_in_days(spark):
    df = spark.createDataFrame([(1, "2000-01-01", 10.0), (1, "2001-01-01", 20.0), (2, "2000-06-01", 3.0)], "c int, m string, v double")
    out = grid.gap_fill_linear(df.withColumn("month", F.col("m").cast("date")), ["c"], "v", "1999-12-01", "2001-02-01").toPandas()
    one = out[out["c"] == 1].sort_values("month")
    days = (pd.to_datetime(one["month"]) - pd.Timestamp("2000-01-01")).dt.days
    np.testing.assert_allclose(one["v"], 10 + 10 * days / 366)
    assert (out[out["c"] == 2]["v"] == 3.0).all() and len(out) == 30


def test_gap_fill_shuffles_known_points_only(spark):
    """Months are made after the last exchange and sort, so no task holds them; rows may repeat, keys be null."""
    known = [(1, "2000-03-01", 3.0), (1, "2000-03-01", 2.0), (1, "2000-01-01", 1.0), (1, "2000-02-01", None), (None, "2000-05-15", 7.0)]
    df = spark.createDataFrame(known, "c int, m string, v double").select("c", F.col("m").cast("date").alias("month"), "v")
    out = grid.gap_fill_linear(df, ["c"], "v", "1999-12-01", "2000-04-01")
    got = {(r.c, str(r.month)[:7]): r.v for r in out.collect()}
    daily = 2 / 60
    assert got == pytest.approx({(1, "1999-12"): 1 - 31 * daily, (1, "2000-01"): 1, (1, "2000-02"): 1 + 31 * daily, (1, "2000-03"): 3, (1, "2000-04"): 3 + 31 * daily, **{(None, m): 7 for m in ("1999-12", "2000-01", "2000-02", "2000-03", "2000-04")}})
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and not any(step in plan.split("Generate")[0] for step in ("Window", "Aggregate", "Join"))


def test_bilinear_matches_formula(spark):
    lat, lon = np.meshgrid(np.arange(0, 3, 0.5), np.arange(0, 3, 0.5), indexing="ij")
    src = pd.DataFrame({"lat": lat.ravel(), "lon": lon.ravel(), "month": 1})
    src["v"] = 2 * src["lat"] - 3 * src["lon"] + 1
    tlat, tlon = np.meshgrid(np.arange(0, 3.1, 0.25), np.arange(0, 3.1, 0.25), indexing="ij")
    tgt = pd.DataFrame({"lat": tlat.ravel(), "lon": tlon.ravel()})
    out = grid.regrid(frame(spark, src), frame(spark, tgt), ["v"], 0.5).toPandas()
    inside = out[(out["lat"] <= 2.5) & (out["lon"] <= 2.5)]
    np.testing.assert_allclose(inside["v"], 2 * inside["lat"] - 3 * inside["lon"] + 1, atol=1e-12)
    assert len(inside) == 121 and out[(out["lat"] > 2.5) | (out["lon"] > 2.5)]["v"].isna().all()


# --- exposure --------------------------------------------------------------


def test_feature_count_and_cover():
    table = exposure.period_table()
    assert len({p.name(v) for p in table for v in exposure.VARIABLES}) == 756
    for scheme, last in (("b", 44), ("q", 20), ("m", 14), ("iu", 14)):
        months = [o for p in table if p.scheme == scheme and p.stat == "avg" for o in range(p.start, p.end + 1)]
        assert sorted(months) == list(range(last + 1))
    with pytest.raises(ValueError):
        exposure.period_table({"b": {"early": 2}}, {"b": ["w4"]})


def test_both_forms_of_exposure_agree(spark):
    pdf = series(cells=3, months=70).drop(index=[5, 6, 100])
    grid_df = frame(spark, pdf).withColumn("w", F.col("v") * 2)
    starts = pd.date_range("1995-01-01", periods=25, freq="MS").date
    points = frame(spark, pd.DataFrame([(c, s) for c in range(3) for s in starts], columns=["cell", "from_date"]))
    stats = {"b": ["avg", "w1", "w2", "w9", "max", "min"], "q": ["avg"]}
    periods = exposure.period_table({k: exposure.SCHEMES[k] for k in stats}, stats)
    wide = exposure.exposure_features(points, grid_df, ["v", "w"], periods, ["cell"])
    long = exposure.period_exposure(points, grid_df, ["v", "w"], periods, ["cell"])
    a = exposure.lengthen_exposure(wide, ["cell", "from_date"], ["v", "w"], periods).filter("value IS NOT NULL").toPandas()
    b = long.filter("value IS NOT NULL").toPandas()
    by = ["cell", "from_date", "var", "scheme", "period", "stat"]
    merged = a.merge(b, on=by, how="outer")
    np.testing.assert_allclose(merged["value_x"], merged["value_y"], rtol=1e-9)
    assert len(merged) == len(a) == len(b) > 5000


def test_event_cuts_periods(spark):
    pdf = series(cells=1, months=60)
    v = pdf["v"].to_numpy()
    start = pdf["month"][0]
    points = spark.createDataFrame([(0, start, 12), (0, start, None)], "cell long, from_date date, e int")
    periods = exposure.period_table({"b": exposure.SCHEMES["b"]}, {"b": ["avg", "w3", "max"]})
    out = exposure.period_exposure(points, frame(spark, pdf), ["v"], periods, ["cell"], event_offset="e").toPandas()
    cut = out[out["e"] == 12].set_index(["period", "stat"])["value"]
    whole = out[out["e"].isna()].set_index(["period", "stat"])["value"]
    assert abs(cut["born_1m6m", "avg"] - v[10:13].mean()) < 1e-9 and abs(cut["born_1m6m", "w3"] - v[10:13].mean()) < 1e-9
    assert abs(cut["born_1m6m", "max"] - v[10:13].max()) < 1e-9
    assert np.isnan(cut["born_6m12m", "avg"]) and np.isnan(cut["born_6m12m", "w3"])
    assert abs(whole["born_6m12m", "w3"] - v[18:21].mean()) < 1e-9
    assert abs(cut["born_1m", "w3"] - v[7:10].mean()) < 1e-9


# --- features, quality -----------------------------------------------------


def test_names_are_parsed():
    p = features.parse_feature("stdm_t_born_1m6m_b_avg_neg_int")
    assert (p.var, p.period, p.scheme, p.stat, p.part, p.product) == ("stdm_t", "born_1m6m", "b", "avg", "neg", True)
    assert features.parse_feature("spi1_inutero_b_w3").stat == "w3"
    assert features.parse_feature("spi1_inutero_b_avg_sq_pos_int").square
    assert features.parse_feature("child_fem") is None
    names = [p.name(v) for p in exposure.period_table() for v in exposure.VARIABLES]
    assert all(features.parse_feature(n) for n in names)


def test_age_dummies_add_up(spark):
    df = spark.createDataFrame([(None,), (0,), (5,), (6,), (35,), (36,)], "age int")
    out = features.age_dummies(df, "age").toPandas()
    for scheme, (_, labels) in features.AGE_BINS.items():
        assert (out[[f"age_{scheme}_{x}" for x in labels]].sum(axis=1) == 1000).all()
    assert out["age_biannual_alive"].tolist() == [1000, 0, 0, 0, 0, 1000]


def test_validate(spark):
    df = spark.createDataFrame([(0, 1), (1, 0)], "a int, b int")
    quality.validate(df, {"a": quality.nonzero_mean("a")}, ["a", "b"])
    with pytest.raises(ValueError, match="failed"):
        quality.validate(df, {"large": F.avg("a") > 5})
    with pytest.raises(ValueError, match="missing"):
        quality.validate(df, {}, ["c"])
    with pytest.raises(ValueError, match="no rows"):
        quality.validate(df.filter("a > 9"), {})
    with pytest.raises(ValueError):
        quality.one_of("spi1_temp", ["spi1", "temp"])


def test_audit_counts_as_rows_pass(spark):
    seen_df, seen = quality.audit(spark.range(50), "rows_seen")
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 50
    assert quality.sample_rows(spark.range(50), 5).count() == 5
    assert [r[0] for r in quality.sample_rows(spark.range(50), 5).collect()] == [r[0] for r in quality.sample_rows(spark.range(50).repartition(4), 5).collect()]
