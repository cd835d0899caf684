"""Series functions, checks in the flow, histograms, sketches, the commit of tables, pruned scans."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridcohort.operators.quality import CheckedWrite, binned_density, checked_rows, density_table, histogram
from gridcohort.operators.quantiles import merged_sketches, quantile_sketches, sketch_quantiles
from gridcohort.operators.series import apply_series
from gridcohort.plans.specs import run_specs
from gridcohort.sources.reports import ingest_reports, read_reports
from gridcohort.sources.tables import commit_table, ensure_table, scan_series, write_series
from test_models import records, spec


def test_series_with_gaps_nulls_and_skips(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [("a", f"2000-{m:02d}-01", float(m)) for m in (1, 2, 5, 6)] + [("b", f"2000-{m:02d}-01", None) for m in (1, 2, 3)]
        rows += [(None, "2001-01-01", 4.0), ("c", None, 9.0), ("c", "2000-03-01", 3.0)] + [(f"k{i}", f"200{y}-07-01", float(y)) for i in range(9) for y in range(4)]
        df = spark.createDataFrame(rows, "cell string, month string, v double").withColumn("month", F.to_date("month")).repartition(3)
        seen = apply_series(df, "v", lambda x: np.full(len(x), float(len(x))), "n", ["cell"])
        got = {(r.cell, str(r.month)): r.n for r in seen.collect()}
        assert len(got) == len(rows) and seen.columns == ["cell", "month", "v", "n"]
        assert all(got["a", f"2000-{m:02d}-01"] == 6.0 for m in (1, 2, 5, 6))
        assert all(got["b", f"2000-{m:02d}-01"] is None for m in (1, 2, 3))
        assert got[None, "2001-01-01"] == 1.0 and got["c", "None"] is None and got["c", "2000-03-01"] == 1.0
        assert all(got[f"k{i}", f"200{y}-07-01"] == 37.0 for i in range(9) for y in range(4))
        before = apply_series(df.filter("cell = 'a'"), "v", lambda x: np.append(np.nan, x[:-1]), "p", ["cell"])
        assert [r.p for r in before.orderBy("month").collect()] == [None, 1.0, None, 5.0]
        assert apply_series(df.filter("v > 100"), "v", lambda x: x, "p", ["cell"]).count() == 0
        with pytest.raises(Exception, match="returned"):
            apply_series(df, "v", lambda x: x[:0], "p", ["cell"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_checks_in_the_flow(spark, tmp_path):
    df = spark.range(10)
    assert checked_rows(df, {"small": F.col("id") < 10}).count() == 10
    with pytest.raises(Exception, match="failed: small at 9"):
        checked_rows(df, {"small": F.col("id") < 9}, "id").write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="failed: known"):
        checked_rows(df, {"known": F.lit(None).cast("boolean")}).collect()
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="none"):
        CheckedWrite(df, {"none": F.max("id") < 0}).to(path)
    with pytest.raises(ValueError, match="no rows"):
        CheckedWrite(df.filter("id < 0"), {"some": F.count("*") == 0}).to(path)
    assert not (tmp_path / "t").exists() and not list(tmp_path.iterdir())
    assert CheckedWrite(df, {"top": F.max("id") == 9}).to(path) == {"rows": 10, "top": True} and spark.read.parquet(path).count() == 10


def test_strict_reports_and_their_names(spark, tmp_path):
    good, bad = "stdm_t_a & 1.000 & 2.000 & 3.000\n & (0.1) & (0.2) & (0.3)", "stdm_t_a & 2.000 & 2.000 & 3.000\n & (0.2) & (0.3)"
    for name, text in (("a", good), ("b b+%", good.replace("1.000", "5.000"))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "t.tex").write_text(text)
    lines = read_reports(spark, str(tmp_path))
    got = {(r.file, r.cell_level): (r.coef, r.se) for r in ingest_reports(lines, strict=True).collect()}
    assert got["a/t.tex", 1] == (1.0, 0.1) and got["b b+%/t.tex", 1] == (5.0, 0.1) and len(got) == 6
    (tmp_path / "a" / "u.tex").write_text(bad)
    assert ingest_reports(read_reports(spark, str(tmp_path))).count() == 9
    with pytest.raises(Exception, match="as many errors as coefficients at a/u.tex"):
        ingest_reports(read_reports(spark, str(tmp_path)), strict=True).collect()


def test_histogram_and_binned_density(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 1, 3000), [-9.0, 4.0, 9.0, np.nan]])
    df = spark.createDataFrame([(None if i % 500 == 7 else float(v), float(-v)) for i, v in enumerate(values)], "a double, b double")
    got = {(r.column, r.bin): r.n for r in histogram(df, ["a", "b"], -4.0, 4.0, 16).collect()}
    a = np.array([v for i, v in enumerate(values) if i % 500 != 7])
    want = np.histogram(a[~np.isnan(a)], 16, (-4.0, 4.0))[0]
    assert [got.get(("a", i), 0) for i in range(1, 17)] == want.tolist()
    assert got["a", 0] == (a < -4).sum() and got["a", 17] == (a > 4).sum() and sum(n for (c, _), n in got.items() if c == "b") == len(values)
    inside = df.select("b").filter("b BETWEEN -4 AND 4")
    exact = {round(r.x, 6): r.density for r in density_table(inside, ["b"], -3.0, 3.0, 13).collect()}
    near = binned_density(inside, ["b"], -4.0, 4.0, 17, 200).collect()
    assert all(abs(r.density - exact[round(r.x, 6)]) <= r.bound for r in near if round(r.x, 6) in exact) and near[0].bound < 0.2


def test_sketches_merge(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 40_009).cast("double").alias("v"))
    parts = [quantile_sketches(df.filter(F.col("v") % 4 == i), ["g"]) for i in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    for found in (sketch_quantiles(merged_sketches(whole, ["g"]), ["g"], [0.1, 0.5, 0.9]), sketch_quantiles(quantile_sketches(df, ["g"]), ["g"], [0.1, 0.5, 0.9])):
        for r in found.collect():
            values = np.sort([x.v for x in df.filter(F.col("g") == r.g).collect()])
            ranks = np.searchsorted(values, r.edges, "right") / len(values)
            assert np.abs(ranks - [0.1, 0.5, 0.9]).max() < 0.0167 and r.n == len(values)


def test_two_drivers_leave_one_table(spark, tmp_path):
    path, builds, gate = str(tmp_path / "t"), [], threading.Barrier(2)

    def build(k):
        builds.append(k)
        gate.wait(60)  # both found no table
        return spark.range(5).withColumn("by", F.lit(k))

    out = {}
    threads = [threading.Thread(target=lambda k=k: out.setdefault(k, ensure_table(spark, path, lambda: build(k)).collect())) for k in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(builds) == [1, 2] and sorted(out[1]) == sorted(out[2]) and len({r.by for r in out[1]}) == 1 and len(out[1]) == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"] and not commit_table(spark.range(3), path)
    (tmp_path / "half").mkdir()
    with pytest.raises(ValueError, match="no finished table"):
        ensure_table(spark, str(tmp_path / "half"), lambda: spark.range(1))


def test_a_time_select_opens_its_years(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(1200).select((F.col("id") % 10).alias("cell"), F.add_months(F.lit("2000-01-01").cast("date"), (F.col("id") / 10).cast("int")).alias("month"), F.col("id").cast("double").alias("v"))
    write_series(df, path)
    some = scan_series(spark, path, "cell long, month date, v double", "2003-05-01", "2004-02-01")
    assert some.columns == ["cell", "month", "v"] and some.count() == 100
    scan = [p for p in some._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in p][0]
    assert "PartitionFilters: [" in scan and "year" in scan.split("PartitionFilters: [")[1].split("]")[0]
    rows = some.collect()
    files = {r.f for r in spark.read.parquet(path).filter("year IN (2003, 2004)").select(F.input_file_name().alias("f")).distinct().collect()}
    read = some._jdf.queryExecution().executedPlan()
    assert len(rows) == 100 and len(files) == 2 and read is not None
    assert scan_series(spark, path, df.schema, last="2000-01-01").count() == 10 and scan_series(spark, path, df.schema).count() == 1200


def test_failures_are_reported_not_raised(spark):
    pdf = records(800)
    df = spark.createDataFrame(pdf).withColumn("zone", F.when(F.col("cell") == 1, "one").otherwise(F.col("zone"))).withColumn("spi1_inutero_b_avg", F.when(F.col("zone") != "wet", F.col("spi1_inutero_b_avg")))
    specs = [spec(cells=("cell",)), spec(cells=("cell",), temp="absent"), spec(cells=("cell",), controls=("rural", "twice"))]
    out = run_specs(df.withColumn("twice", F.col("rural") * 2), specs, "zone").toPandas()
    assert out[out["spec_id"].str.contains("absent")]["status"].str.startswith("columns missing").all()
    rest = out[~out["spec_id"].str.contains("absent")]
    assert (rest[rest["group_value"] == "wet"]["status"] == "no rows").all() and rest[rest["group_value"] == "wet"]["coef"].isna().all()
    one = rest[(rest["group_value"] == "one") & rest["coef"].notna()]
    assert len(one) and set(one["status"]) == {"one cluster"} and one["se"].isna().all()
    dry = rest[rest["group_value"] == "dry"]
    assert set(dry[dry["term"] == "twice"]["status"]) == {"collinear"} and set(dry[dry["term"] != "twice"]["status"]) == {"ok"}
