"""Queries over the gridded series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import add_sign_columns, celsius, month_start, positive_only, snap, threshold_flag, wrap_longitude
from ..functions.special import QUANTILE_A, QUANTILE_B, QUANTILE_C, QUANTILE_D, QUANTILE_TAIL
from ..operators.cohort import dense_group_id
from ..operators.grid import (
    anomalies,
    cell_means,
    climatology,
    coordinate_merge,
    exceedance_share,
    gap_fill_linear,
    land_mask,
    month_totals,
    regrid,
    rolling_mean,
    rolling_sum,
    select_box,
    select_months,
    standardized_anomaly,
)
from ..operators.spi import spi, spi_scales
from .registry import query
from .roles import (
    ANOMALY_SQL,
    GRID_FINE_SQL,
    GRID_SQL,
    anomaly_grid,
    grid_coarse,
    grid_fine,
    lat_sql,
    latitude,
    lon_sql,
    longitude,
    table,
)

INDEX = "(year(month) * 12 + month(month))"


@query(
    "cell:i month:d stdm_t:f absdifm_t:f",
    f"""WITH {GRID_SQL}
    SELECT cell, month, (t2m - avg(t2m) OVER w) / nullif(stddev_pop(t2m) OVER w, 0) AS stdm_t,
           t2m - avg(t2m) OVER w AS absdifm_t
    FROM grid WINDOW w AS (PARTITION BY cell, month(month))""",
)
def monthly_anomaly(spark, d):
    grid = standardized_anomaly(grid_coarse(spark, d), "t2m", "stdm_t", ["cell"])
    return standardized_anomaly(grid, "t2m", "absdifm_t", ["cell"], scale=False)


@query(
    "cell:i month:d std_t:f absdif_t:f stdm_t:f absdifm_t:f",
    f"""WITH {GRID_SQL}, ref AS (
      SELECT *, CASE WHEN year(month) BETWEEN 1996 AND 1999 THEN t2m END AS base FROM grid)
    SELECT cell, month, (t2m - avg(base) OVER c) / nullif(stddev_pop(base) OVER c, 0) AS std_t,
           t2m - avg(base) OVER c AS absdif_t,
           (t2m - avg(base) OVER m) / nullif(stddev_pop(base) OVER m, 0) AS stdm_t,
           t2m - avg(base) OVER m AS absdifm_t
    FROM ref WINDOW c AS (PARTITION BY cell), m AS (PARTITION BY cell, month(month))""",
)
def overall_anomaly(spark, d):
    return anomalies(grid_coarse(spark, d), "t2m", ["cell"], baseline=(1996, 1999))


@query(
    "cell:i moy:i mean:f sd:f n:i",
    f"""WITH {GRID_FINE_SQL}
    SELECT cell, month(month) AS moy, avg(t2m) AS mean, stddev_pop(t2m) AS sd, count(t2m) AS n
    FROM grid GROUP BY 1, 2""",
)
def monthly_climatology(spark, d):
    return climatology(grid_fine(spark, d), "t2m", ["cell"], by_month=True)


@query(
    "cell:i month:d trailing6:f trailing9:f centred3:f",
    f"""WITH {GRID_FINE_SQL}, n AS (SELECT *, {INDEX} AS i FROM grid)
    SELECT cell, month, CASE WHEN count(t2m) OVER a = 6 THEN avg(t2m) OVER a END AS trailing6,
           CASE WHEN count(t2m) OVER b = 9 THEN avg(t2m) OVER b END AS trailing9,
           CASE WHEN count(t2m) OVER c = 3 THEN avg(t2m) OVER c END AS centred3
    FROM n WINDOW a AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 5 PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 8 PRECEDING AND CURRENT ROW),
                  c AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
)
def rolling_mean_full_window(spark, d):
    grid = grid_fine(spark, d)
    for k, name, centred in ((6, "trailing6", False), (9, "trailing9", False), (3, "centred3", True)):
        grid = rolling_mean(grid, "t2m", k, name, ["cell"], centered=centred)
    return grid


@query(
    "cell:i month:d sum3:f sum12:f",
    f"""WITH {GRID_FINE_SQL}, n AS (SELECT *, {INDEX} AS i FROM grid)
    SELECT cell, month, CASE WHEN count(tp) OVER a = 3 THEN sum(tp) OVER a END AS sum3,
           CASE WHEN count(tp) OVER b = 12 THEN sum(tp) OVER b END AS sum12
    FROM n WINDOW a AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 2 PRECEDING AND CURRENT ROW),
                  b AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)
def rolling_accumulation(spark, d):
    grid = rolling_sum(grid_fine(spark, d), "tp", 3, "sum3", ["cell"])
    return rolling_sum(grid, "tp", 12, "sum12", ["cell"])


@query(
    "cell:i month:d stdm_t_pos:b stdm_t_neg:b stdm_t_pos_int:f stdm_t_neg_int:f spi1_pos:b spi1_neg:b",
    f"""WITH {GRID_SQL}, {ANOMALY_SQL}
    SELECT cell, month, coalesce(stdm_t >= 0, false) AS stdm_t_pos, coalesce(stdm_t <= 0, false) AS stdm_t_neg,
           CASE WHEN stdm_t > 0 THEN stdm_t WHEN stdm_t <= 0 THEN 0 END AS stdm_t_pos_int,
           CASE WHEN stdm_t < 0 THEN stdm_t WHEN stdm_t >= 0 THEN 0 END AS stdm_t_neg_int,
           coalesce(spi1 >= 0, false) AS spi1_pos, coalesce(spi1 <= 0, false) AS spi1_neg
    FROM anomaly""",
)
def sign_parts(spark, d):
    return add_sign_columns(anomaly_grid(spark, d), ["stdm_t", "spi1"])


@query(
    "cell:i above:f below:f",
    f"""WITH {GRID_SQL}, {ANOMALY_SQL}, n AS (SELECT *, {INDEX} AS i FROM anomaly), rolled AS (
      SELECT cell, CASE WHEN count(stdm_t) OVER c = 3 THEN avg(stdm_t) OVER c END AS r
      FROM n WINDOW c AS (PARTITION BY cell ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    SELECT cell, CAST(count(*) FILTER (r > 0.75) AS DOUBLE) / 84 AS above,
           CAST(count(*) FILTER (r < -0.75) AS DOUBLE) / 84 AS below
    FROM rolled GROUP BY 1""",
)
def exceedance(spark, d):
    rolled = rolling_mean(anomaly_grid(spark, d), "stdm_t", 3, "r", ["cell"], centered=True)
    above = exceedance_share(rolled, "r", 0.75, "above", "above", 84, ["cell"])
    below = exceedance_share(rolled, "r", 0.75, "below", "below", 84, ["cell"])
    return coordinate_merge([above, below], ["cell"])


@query(
    "cell:i month:d t:f tp:f",
    f"""WITH {GRID_FINE_SQL}
    SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.month, b.month) AS month, a.t, b.tp
    FROM (SELECT cell, month, t2m - 273.15 AS t FROM grid WHERE month <= DATE '1999-06-01') a
    FULL JOIN (SELECT cell, month, tp FROM grid WHERE month >= DATE '1998-03-01') b
      ON a.cell = b.cell AND a.month = b.month""",
)
def coordinate_alignment(spark, d):
    grid = grid_fine(spark, d)
    first = select_months(grid, "1900-01-01", "1999-06-01").select("cell", "month", celsius("t2m").alias("t"))
    second = select_months(grid, "1998-03-01", "2100-01-01").select("cell", "month", "tp")
    return coordinate_merge([first, second], ["cell", "month"])


@query(
    "id:i lon:f quarter:f centre:f half:f whole:f ID_cell:i",
    f"""WITH p AS (
      SELECT c_custkey AS id, {lat_sql("c_custkey")} AS lat, CAST(c_custkey * 53 % 3600 AS DOUBLE) / 10 AS east
      FROM customer), w AS (SELECT *, CASE WHEN east > 180 THEN east - 360 ELSE east END AS lon FROM p)
    SELECT id, lon, round_even(lat * 4, 0) / 4 AS quarter,
           round_even((lat - CAST(0.25 AS DOUBLE)) * 2, 0) / 2 + 0.25 AS centre,
           round_even(lat * 2, 0) / 2 AS half, round_even(lat, 0) AS whole,
           dense_rank() OVER (ORDER BY round_even(lat, 0) + CAST(0 AS DOUBLE), round_even(lon, 0) + CAST(0 AS DOUBLE)) - 1
             AS "ID_cell"
    FROM w""",
)
def grid_snap(spark, d):
    points = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        latitude("c_custkey").alias("lat"),
        ((F.col("c_custkey") * 53 % 3600).cast("double") / 10).alias("lon"),
    )
    snapped = wrap_longitude(points).withColumns(
        {
            "quarter": snap("lat", 0.25),
            "centre": snap("lat", 0.5, 0.25),
            "half": snap("lat", 0.5),
            "whole": snap("lat", 1.0) + F.lit(0.0),
            "lon_cell": snap("lon", 1.0) + F.lit(0.0),
        }
    )
    return dense_group_id(snapped, ["whole", "lon_cell"], "ID_cell")


@query(
    "lat:f lon:f month:d tp:f",
    f"""SELECT {lat_sql("l_suppkey")} AS lat, {lon_sql("l_suppkey")} AS lon,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS month, sum(l_quantity) AS tp
    FROM lineitem
    WHERE {lat_sql("l_suppkey")} BETWEEN -45 AND 45 AND {lon_sql("l_suppkey")} BETWEEN -100 AND 120
      AND CAST(date_trunc('month', l_shipdate) AS DATE) BETWEEN DATE '1996-02-01' AND DATE '1999-03-01'
    GROUP BY 1, 2, 3""",
)
def box_and_time_select(spark, d):
    grid = grid_fine(spark, d).withColumns({"lat": latitude("cell"), "lon": longitude("cell")})
    return select_months(select_box(grid, (-45, 45), (-100, 120)), "1996-02-01", "1999-03-01")


@query(
    "cell:i month:d t2m:f flag:i",
    f"""WITH {GRID_FINE_SQL}, land AS (SELECT DISTINCT cell FROM grid WHERE month = DATE '1997-05-01' AND tp > 100)
    SELECT grid.cell, month, CASE WHEN land.cell IS NOT NULL THEN t2m END AS t2m,
           CASE WHEN tp >= 250 THEN 1 WHEN tp < 250 THEN 0 END AS flag
    FROM grid LEFT JOIN land ON grid.cell = land.cell""",
)
def masked_grid(spark, d):
    grid = grid_fine(spark, d)
    land = select_months(grid, "1997-05-01", "1997-05-01").filter("tp > 100").select("cell", positive_only("tp").alias("land"))
    return land_mask(grid, land, "t2m", ["cell"]).withColumn("flag", threshold_flag("tp", 250))


@query(
    "cell:i mean_t:f",
    f"WITH {GRID_FINE_SQL} SELECT cell, avg(t2m) AS mean_t FROM grid GROUP BY 1",
)
def time_mean_by_cell(spark, d):
    return cell_means(grid_fine(spark, d).select("cell", F.col("t2m").alias("mean_t")), ["mean_t"], ["cell"])


@query("month:d tp:f", f"WITH {GRID_FINE_SQL} SELECT month, sum(tp) AS tp FROM grid GROUP BY 1")
def total_by_month(spark, d):
    return month_totals(grid_fine(spark, d), ["tp"])


# --- gap filling and regridding --------------------------------------------


@query(
    "cell:i month:d value:f",
    """WITH known AS (
      SELECT o_custkey AS cell, CAST(date_trunc('year', o_orderdate) AS DATE) AS month, avg(o_totalprice) AS value
      FROM orders GROUP BY 1, 2),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY cell ORDER BY month) AS a,
             row_number() OVER (PARTITION BY cell ORDER BY month DESC) AS z FROM known),
    ends AS (
      SELECT cell, max(CASE WHEN a = 1 THEN month END) AS m1, max(CASE WHEN a = 1 THEN value END) AS v1,
             max(CASE WHEN a = 2 THEN month END) AS m2, max(CASE WHEN a = 2 THEN value END) AS v2,
             max(CASE WHEN z = 1 THEN month END) AS m9, max(CASE WHEN z = 1 THEN value END) AS v9,
             max(CASE WHEN z = 2 THEN month END) AS m8, max(CASE WHEN z = 2 THEN value END) AS v8
      FROM ranked GROUP BY 1),
    months AS (
      SELECT cell, CAST(m AS DATE) AS month
      FROM (SELECT DISTINCT cell FROM known),
           generate_series(TIMESTAMP '1994-07-01', TIMESTAMP '2002-06-01', INTERVAL 1 MONTH) AS g(m)),
    pairs AS (SELECT cell, month AS m1, value AS v1, lead(month) OVER w AS m2, lead(value) OVER w AS v2
              FROM known WINDOW w AS (PARTITION BY cell ORDER BY month))
    SELECT t.cell, t.month,
           CASE WHEN e.m2 IS NULL THEN e.v1
                WHEN t.month < e.m1 THEN e.v1 + (e.v2 - e.v1) / (e.m2 - e.m1) * (t.month - e.m1)
                WHEN t.month >= e.m9 THEN e.v8 + (e.v9 - e.v8) / (e.m9 - e.m8) * (t.month - e.m8)
                ELSE p.v1 + (p.v2 - p.v1) / (p.m2 - p.m1) * (t.month - p.m1) END AS value
    FROM months t JOIN ends e ON t.cell = e.cell
    LEFT JOIN pairs p ON p.cell = t.cell AND t.month >= p.m1 AND t.month < p.m2""",
)
def time_gap_fill(spark, d):
    yearly = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("cell"), F.trunc("o_orderdate", "year").alias("month"))
        .agg(F.avg("o_totalprice").alias("value"))
    )
    return gap_fill_linear(yearly, ["cell"], "value", "1994-07-01", "2002-06-01")


COARSE_NODES_SQL = """node AS (
  SELECT CAST(l_suppkey % 10 AS DOUBLE) * 0.5 AS lat, CAST(l_suppkey // 10 % 10 AS DOUBLE) * 0.5 AS lon,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_extendedprice) AS v
  FROM lineitem GROUP BY 1, 2, 3),
target AS (
  SELECT DISTINCT CAST(c_custkey % 19 AS DOUBLE) * 0.25 AS lat, CAST(c_custkey // 19 % 19 AS DOUBLE) * 0.25 AS lon
  FROM customer)"""


def _nodes(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy(
            ((F.col("l_suppkey") % 10).cast("double") * 0.5).alias("lat"),
            (F.floor(F.col("l_suppkey") / 10) % 10).cast("double").alias("j"),
            month_start("l_shipdate").alias("month"),
        )
        .agg(F.avg("l_extendedprice").alias("v"))
        .select("lat", (F.col("j") * 0.5).alias("lon"), "month", "v")
    )


def _targets(spark, d):
    key = F.col("c_custkey")
    return (
        table(spark, d, "customer")
        .select(
            ((key % 19).cast("double") * 0.25).alias("lat"),
            ((F.floor(key / 19) % 19).cast("double") * 0.25).alias("lon"),
        )
        .distinct()
    )


@query(
    "lat:f lon:f month:d v:f",
    f"""WITH {COARSE_NODES_SQL}, corner AS (
      SELECT t.lat, t.lon, floor(t.lat * 2) / 2 + dy.d AS nlat, floor(t.lon * 2) / 2 + dx.d AS nlon,
             1 - abs(t.lat - (floor(t.lat * 2) / 2 + dy.d)) * 2 AS wy, 1 - abs(t.lon - (floor(t.lon * 2) / 2 + dx.d)) * 2 AS wx
      FROM target t, (VALUES (CAST(0 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) dy(d),
           (VALUES (CAST(0 AS DOUBLE)), (CAST(0.5 AS DOUBLE))) dx(d)),
    used AS (SELECT *, wx * wy AS w, count(*) OVER (PARTITION BY lat, lon) AS need FROM corner WHERE wx * wy > 0)
    SELECT u.lat, u.lon, n.month, CASE WHEN count(n.v) = max(u.need) THEN sum(n.v * u.w) END AS v
    FROM used u JOIN node n ON n.lat = u.nlat AND n.lon = u.nlon GROUP BY 1, 2, 3""",
)
def bilinear_regrid(spark, d):
    return regrid(_nodes(spark, d), _targets(spark, d), ["v"], 0.5)


@query(
    "lat:f lon:f month:d v:f",
    f"""WITH {COARSE_NODES_SQL}
    SELECT t.lat, t.lon, n.month, n.v FROM target t
    JOIN node n ON n.lat = round_even(t.lat * 2, 0) / 2 AND n.lon = round_even(t.lon * 2, 0) / 2""",
)
def nearest_regrid(spark, d):
    return regrid(_nodes(spark, d), _targets(spark, d), ["v"], 0.5, method="nearest")


# --- SPI -------------------------------------------------------------------


def _poly(x: str, coefficients, one: bool = False) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return f"({out} * {x} + 1)" if one else out


def _quantile_sql(p: str) -> str:
    q, z, c = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    r = f"({c} * {c})"
    return f"""CASE WHEN {p} < {QUANTILE_TAIL} THEN {_poly(q, QUANTILE_C)} / {_poly(q, QUANTILE_D, True)}
      WHEN {p} > {1 - QUANTILE_TAIL} THEN -{_poly(z, QUANTILE_C)} / {_poly(z, QUANTILE_D, True)}
      ELSE {_poly(r, QUANTILE_A)} * {c} / {_poly(r, QUANTILE_B, True)} END"""


def _spi_sql(scale: int, calibration: str = "x") -> str:
    return f"""WITH {GRID_SQL}, n AS (SELECT *, {INDEX} AS i FROM grid), acc AS (
      SELECT cell, month, CASE WHEN count(tp) OVER a = {scale} THEN sum(tp) OVER a END AS x
      FROM n WINDOW a AS (PARTITION BY cell ORDER BY i RANGE BETWEEN {scale - 1} PRECEDING AND CURRENT ROW)),
    cal AS (SELECT *, {calibration} AS c FROM acc),
    stats AS (
      SELECT cell, month, x, avg(CAST(c <= 0 AS DOUBLE)) OVER m AS q, avg(CASE WHEN c > 0 THEN c END) OVER m AS mu,
             ln(avg(CASE WHEN c > 0 THEN c END) OVER m) - avg(CASE WHEN c > 0 THEN ln(c) END) OVER m AS a
      FROM cal WINDOW m AS (PARTITION BY cell, month(month))),
    fit AS (SELECT *, CASE WHEN a > 1e-12 THEN (1 + sqrt(1 + 4 * a / 3)) / (4 * a) END AS shape FROM stats),
    std AS (SELECT *, x * shape / mu AS z FROM fit),
    -- P(shape, z) = sum over k of z^(shape + k) e^-z / gamma(shape + k + 1), walked from the largest terms
    cdf AS (SELECT *, list_sum(list_transform(
        range(CAST(greatest(0, floor(z - shape - 14 * sqrt(z) - 60)) AS BIGINT),
              CAST(greatest(0, z - shape) + 14 * sqrt(z) + 60 AS BIGINT)),
        lambda k: exp((shape + k) * ln(z) - z - lgamma(shape + k + 1)))) AS p FROM std),
    mixed AS (SELECT cell, month, CASE WHEN p IS NOT NULL THEN least(greatest(q + (1 - q) * p, 1e-12), 1 - 1e-12) END AS h FROM cdf)
    SELECT cell, month, CASE WHEN h IS NOT NULL THEN least(greatest({_quantile_sql("h")}, -3.09), 3.09) END AS spi{scale} FROM mixed"""


@query(
    "cell:i month:d spi1:f spi3:f spi12:f",
    f"SELECT * FROM ({_spi_sql(1)}) JOIN ({_spi_sql(3)}) USING (cell, month) JOIN ({_spi_sql(12)}) USING (cell, month)",
)
def spi_all_scales(spark, d):
    """Several accumulation scales in one exchange, fitted on all years."""
    return spi_scales(grid_coarse(spark, d), "tp", (1, 3, 12), keys=["cell"]).select("cell", "month", "spi1", "spi3", "spi12")


@query("cell:i month:d spi3:f", _spi_sql(3, "CASE WHEN year(month) BETWEEN 1996 AND 2000 THEN x END"))
def spi_gamma(spark, d):
    return spi(grid_coarse(spark, d), "tp", 3, calib=(1996, 2000), keys=["cell"])
