import re

import pytest
from pyspark.sql import functions as F

from gridcohort.operators.exposure import exposure_features, period_table
from gridcohort.session import colocate, drop_intermediates

PERIODS = [p for p in period_table() if p.scheme == "b"][:4]


@pytest.fixture
def frames(spark):
    months = spark.range(60).select(F.expr("add_months(date'2000-01-01', cast(id as int))").alias("month"), F.col("id").alias("m"))
    cells = spark.range(12).select((F.col("id") % 4).alias("lat"), F.floor(F.col("id") / 4).alias("lon"))
    grid = cells.crossJoin(months).filter("m % 11 <> lat").selectExpr("lat", "lon", "month", "lat * 100.0D + lon * 10 + m AS v")
    nulls = spark.createDataFrame([(None, 1, 5.0)], "lat long, lon long, v double").selectExpr("lat", "lon", "date'2000-01-01' AS month", "v")
    points = grid.filter("month(month) = 7").select("lat", "lon", F.col("month").alias("from_date"))
    points = points.filter("lat < 3").union(spark.sql("SELECT null, 1L, date'2000-01-01'")).union(spark.sql("SELECT 99L, 1L, date'2000-01-01'"))
    return grid.union(nulls), points


def wide(points, grid):
    return exposure_features(points, grid, ["v"], PERIODS)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_exposure_moves_no_grid_row(spark, frames, broadcast):
    """Also beside null keys, points without a grid and cells without a point."""
    grid, points = frames
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        want = sorted(map(tuple, wide(points, grid).collect()))
        g, p = colocate(["lat", "lon"], grid, points.distinct(), sort=[["month"], ["from_date"]], buckets=8)
        out = wide(p, g)
        assert sorted(map(tuple, out.collect())) == want and want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange (hash|range|single|round)", plan), plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_tables_of_buckets(spark, frames):
    grid, points = frames
    tables = colocate(["lat", "lon"], grid, points, grid.limit(0), rows=100)
    assert [t.count() for t in tables] == [grid.count(), points.count(), 0]
    assert tables[0].rdd.getNumPartitions() <= 8 and tables[0].exceptAll(grid).count() == 0
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {_name(tables[0])}").collect()}
    assert described["Num Buckets"] == "7" and described["Bucket Columns"] == "[`lat`, `lon`]"
    assert colocate(["lat", "lon"], grid.limit(0))[0].count() == 0
    drop_intermediates(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gridcohort_")]


def _name(df):
    return re.search(r"gridcohort_[0-9a-f]{32}", df._jdf.queryExecution().analyzed().toString())[0]
