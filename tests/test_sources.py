from pyspark.sql import functions as F

from gridcohort.sources import reports, tables

REPORT = r"""\begin{tabular}{lrrrrrr}
\toprule
 & (1) & (2) & (3) & (4) & (5) & (6) \\
\midrule
spi1\_inutero\_b\_avg\_neg\_int & 0.237 & -0.071 & 0.098* & & -0.287** & -0.231 \\
 & (0.439) & (0.443) & (0.048) & & (0.131) & (0.419) \\
stdm\_t\_born\_1m6m\_b\_avg\_pos\_int & 1.298*** & 1.234 & 1.245 & -2.5*** & 0.953 & 0.912 \\
 & (0.334) & (0.340) & (0.340) & (0.290) & (0.278) & (0.280) \\
child\_fem & 9 & 9 & 9 & 9 & 9 & 9 \\
 & (1) & (1) & (1) & (1) & (1) & (1) \\
$N$ & 4,283,028 & 4,273,601 & 1 & 2 & 3 & 4 \\
\bottomrule
\end{tabular}
"""


def test_reports_from_files(spark, tmp_path):
    (tmp_path / "a.tex").write_text(REPORT)
    (tmp_path / "b.txt").write_text(REPORT)
    lines = reports.read_reports(spark, str(tmp_path))
    assert lines.select("file").distinct().collect()[0][0] == "a.tex"
    out = reports.ingest_reports(lines).toPandas()
    assert len(out) == 12 and out["coef"].notna().sum() == 11
    first = out[(out["kind"] == "spi") & (out["outcome"] == 0) & (out["cell_level"] == 3)].iloc[0]
    assert (first["coef"], first["se"], first["n_stars"], first["key"]) == (0.098, 0.048, 1, "inutero_b_avg_neg_int")
    temp = out[(out["kind"] == "temp") & (out["outcome"] == 1) & (out["cell_level"] == 1)].iloc[0]
    assert (temp["coef"], temp["se"], temp["n_stars"]) == (-2.5, 0.29, 3)
    assert set(reports.ingest_reports(lines, drop_last=1).toPandas()["outcome"]) == {0}
    assert reports.sample_sizes(lines).collect()[0]["n"] == 4283028
    counts = reports.star_counts(lines).toPandas().set_index("specification")
    assert counts.loc[4, ["estimates", "p10_neg", "p05_neg", "p01_neg"]].tolist() == [2, 1, 1, 0]
    assert counts.loc[3, ["estimates", "p01_neg", "p10_pos"]].tolist() == [1, 1, 0]
    assert reports.report_body(lines, 4, 3).agg(F.min("line_no"), F.max("line_no")).first()[0] == 4


def test_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text("lon,rwi\n1.5,0.25\n2.5,-1\n")
    (tmp_path / "in" / "y.csv").write_text("lon,rwi\n3.5,7\n")
    (tmp_path / "in" / "note.txt").write_text("lon,rwi\n9,9\n")
    df = tables.read_csv_folder(spark, str(tmp_path / "in"), "lon double, rwi double")
    assert sorted(map(tuple, df.collect())) == [(1.5, 0.25), (2.5, -1.0), (3.5, 7.0)]
    small = tables.read_lookup(spark, str(tmp_path / "in" / "x.csv"), "lon double, rwi double", {"lon": "code"}, ["code"])
    assert small.columns == ["code"] and small.count() == 2

    calls = []
    build = lambda: calls.append(1) or df
    path = str(tmp_path / "made")
    assert tables.ensure_table(spark, path, build).count() == 3
    assert tables.ensure_table(spark, path, build).count() == 3 and len(calls) == 1

    grid = spark.range(200).select((F.col("id") % 40 - 20).cast("double").alias("lat"), F.col("id").alias("v"))
    banded = str(tmp_path / "banded")
    tables.write_banded(grid, banded, rows=50)
    back = tables.read_series(spark, banded)
    assert back.count() == 200
    plan = back.filter("lat_band = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lat_band" in plan
    pruned = tables.read_columns(spark, banded, lambda c: c == "v")
    assert pruned.columns == ["lat", "lat_band"]
    tables.append_csv(df, str(tmp_path / "log"))
    tables.append_csv(df, str(tmp_path / "log"))
    assert tables.read_csv_folder(spark, str(tmp_path / "log"), "lon double, rwi double").count() == 6
