"""Queries over records: cohort, exposure, enrichment, features, diagnostics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.columns import (
    add_powers,
    day_count_bins,
    interval_bin,
    natural_key,
    snap,
    southern,
    yes_flag,
)
from ..operators.cohort import birth_cohort, birth_order, dense_group_id, distinct_points, rank_within, row_ids, survivors
from ..operators.exposure import (
    SCHEMES,
    WINDOW_MONTHS,
    Period,
    assign_exposure,
    exposure_features,
    exposure_window,
    period_exposure,
    period_table,
    widen_exposure,
)
from ..operators.features import AGE_BINS, CLASS_LEVEL_1, CLASS_LEVEL_2, CLASS_LEVEL_3, age_dummies, class_labels, narrow_types
from ..operators.joins import (
    cell_lookup,
    checked_join,
    dedupe,
    label_codes,
    nearest_cell,
    nearest_within,
    semi_anti_split,
    with_cell_index,
    skew_join,
)
from ..operators.quality import binned_density, column_means, density_table, describe_table, distinct_count, distinct_values, frequency, histogram, sparse_cells
from ..operators.quantiles import merged_sketches, outside_quantiles, quantile_bin, quantile_sketches, sketch_quantiles
from ..operators.series import apply_series
from ..session import colocate, materialize
from .registry import query
from .roles import (
    ANALYSIS_SQL,
    ANOMALY_SQL,
    BIRTHS_SQL,
    GRID_SQL,
    POINTS_SQL,
    analysis,
    anomaly_grid,
    births,
    lat_sql,
    latitude,
    lon_sql,
    longitude,
    table,
    grid_coarse,
)

# --- cohort ----------------------------------------------------------------

CMC = "((year(birth_date) - 1900) * 12 + month(birth_date) + id % 200)"


@query(
    "id:i birth_date:d from_date:d to_date:d interview_date:d interview_year:i interview_month:i "
    "days_from_interview:i last_15_years:b last_10_years:b since_2003:b",
    f"""WITH {BIRTHS_SQL}, asked AS (
      SELECT *, CAST(birth_date + INTERVAL 35 MONTH AS DATE) AS to_date, 1900 + ({CMC} - 1) // 12 AS interview_year,
             {CMC} AS cmc FROM births),
    dated AS (
      SELECT *, cmc - 12 * (interview_year - 1900) AS interview_month,
             make_date(interview_year, cmc - 12 * (interview_year - 1900), 1) AS interview_date FROM asked),
    gap AS (SELECT *, datediff('day', birth_date, interview_date) AS days_from_interview FROM dated)
    SELECT *, days_from_interview > 30 AND days_from_interview < 5475 AS last_15_years,
           days_from_interview > 30 AND days_from_interview < 3650 AS last_10_years, interview_year >= 2003 AS since_2003
    FROM gap WHERE from_date > DATE '1995-03-01' AND to_date < DATE '2004-01-01'
     AND days_from_interview > 30 AND days_from_interview < 5475""",
)
def cohort_window(spark, d):
    records = births(spark, d).select(
        "id",
        F.year("birth_date").alias("chb_year"),
        F.month("birth_date").alias("chb_month"),
        ((F.year("birth_date") - 1900) * 12 + F.month("birth_date") + F.col("id") % 200).alias("v008"),
    )
    return birth_cohort(records, ("1995-03-01", "2004-01-01"))


@query(
    "id:i birth_order:i",
    f"""WITH {BIRTHS_SQL}
    SELECT id, row_number() OVER (PARTITION BY mother ORDER BY birth_date, id) AS birth_order FROM births""",
)
def birth_rank(spark, d):
    return birth_order(births(spark, d), "mother", "birth_date", "id")


@query(
    "id:i place:i",
    """SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS place
    FROM orders""",
)
def rank_in_large_groups(spark, d):
    """Three keys hold all rows; each is ranked in slices of 4096 ids."""
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return rank_within(orders, ["o_orderstatus"], ["o_orderpriority"], "id", "place")


@query(
    "cell:i from_date:d",
    f"WITH {BIRTHS_SQL} SELECT DISTINCT cell, from_date FROM births",
)
def unique_points(spark, d):
    return distinct_points(births(spark, d), ["cell", "from_date"])


@query(
    "id:i row:i cell_id:i",
    f"""WITH {BIRTHS_SQL} SELECT id, row_number() OVER (ORDER BY id) - 1 AS row,
           dense_rank() OVER (ORDER BY cell, birth_date) AS cell_id FROM births""",
)
def surrogate_ids(spark, d):
    records = births(spark, d).select("id", "cell", "birth_date")
    return dense_group_id(row_ids(records, ["id"], "row"), ["cell", "birth_date"], "cell_id", start=1)


@query(
    "id:i age:i",
    f"WITH {BIRTHS_SQL} SELECT id, age FROM births WHERE age IS NULL OR age >= 5",
)
def survivor_filter(spark, d):
    return survivors(births(spark, d), "age", 5)


@query(
    "mother:i id:i birth_date:d",
    f"""WITH {BIRTHS_SQL} SELECT mother, id, birth_date FROM births
    QUALIFY row_number() OVER (PARTITION BY mother ORDER BY birth_date, id) = 1""",
)
def first_per_mother(spark, d):
    return dedupe(births(spark, d).select("mother", "id", "birth_date"), ["mother"], ["birth_date", "id"])


# --- exposure --------------------------------------------------------------

WINDOW_SQL = """seen AS (
  SELECT p.*, datediff('month', p.from_date, g.month) AS off, g.spi1, g.stdm_t
  FROM points p JOIN anomaly g ON g.cell = p.cell AND g.month BETWEEN p.from_date AND p.from_date + INTERVAL 44 MONTH)"""
EXPOSURE_BASE = f"{GRID_SQL}, {ANOMALY_SQL}, {BIRTHS_SQL}, {POINTS_SQL}, {WINDOW_SQL}"


def _stats(scheme_stats) -> list[Period]:
    """Every scheme with the given statistics."""
    return period_table(SCHEMES, {s: scheme_stats for s in SCHEMES})


def _values_sql(periods) -> str:
    return ", ".join(f"('{p.scheme}', '{p.period}', '{p.stat}', {p.start}, {p.first}, {p.end})" for p in periods)


def _long_sql(periods) -> str:
    return f"""period(scheme, period, stat, start, first, stop) AS (VALUES {_values_sql(periods)}),
    long AS (SELECT *, unnest(['spi1', 'stdm_t']) AS var, unnest([spi1, stdm_t]) AS x FROM seen)
    SELECT cell, from_date, var, scheme, period, stat,
           CASE stat WHEN 'max' THEN max(x) WHEN 'min' THEN min(x) ELSE avg(x) END AS value
    FROM long JOIN period ON off BETWEEN first AND stop GROUP BY cell, from_date, var, scheme, period, stat"""


@query(
    "cell:i from_date:d offset:i spi1:f stdm_t:f",
    f"""WITH {EXPOSURE_BASE} SELECT cell, from_date, off AS "offset", spi1, stdm_t FROM seen""",
)
def exposure_months(spark, d):
    points = distinct_points(births(spark, d), ["cell", "from_date"])
    return exposure_window(points, anomaly_grid(spark, d), ["spi1", "stdm_t"], ["cell"])


@query(
    "cell:i from_date:d var:s scheme:s period:s stat:s value:f",
    f"WITH {EXPOSURE_BASE}, {_long_sql(_stats(['avg', 'max', 'min']))}",
)
def period_statistics(spark, d):
    points = births(spark, d).select("cell", "from_date")
    return period_exposure(points, anomaly_grid(spark, d), ["spi1", "stdm_t"], _stats(["avg", "max", "min"]), ["cell"])


TRAILING = [p for p in period_table() if p.scheme == "b" and p.stat in ("w1", "w3", "w9")]


def _wide_sql(periods, values=("spi1", "stdm_t")) -> str:
    cols = ", ".join(
        f'avg(CASE WHEN off BETWEEN {p.first} AND {p.end} THEN {v} END) AS "{p.name(v)}"' for p in periods for v in values
    )
    return f"SELECT cell, from_date, {cols} FROM seen GROUP BY 1, 2"


def _wide_columns(periods, values=("spi1", "stdm_t")) -> str:
    return "cell:i from_date:d " + " ".join(f"{p.name(v)}:f" for p in periods for v in values)


@query(_wide_columns(TRAILING), f"WITH {EXPOSURE_BASE} SELECT * FROM ({_wide_sql(TRAILING)})")
def trailing_exposure(spark, d):
    points = births(spark, d).select("cell", "from_date")
    return exposure_features(points, anomaly_grid(spark, d), ["spi1", "stdm_t"], TRAILING, ["cell"])


@query(_wide_columns(TRAILING), f"WITH {EXPOSURE_BASE} SELECT * FROM ({_wide_sql(TRAILING)})")
def colocated_exposure(spark, d):
    """Grid and points in equal buckets of the cell: the exposure moves no row of either."""
    points = births(spark, d).select("cell", "from_date").distinct()
    grid = anomaly_grid(spark, d).select("cell", "month", "spi1", "stdm_t")
    grid, points = colocate(["cell"], grid, points, sort=[["month"], ["from_date"]])
    return exposure_features(points, grid, ["spi1", "stdm_t"], TRAILING, ["cell"])


AVERAGES = [p for p in period_table() if p.stat == "avg"]


@query(_wide_columns(AVERAGES), f"WITH {EXPOSURE_BASE} SELECT * FROM ({_wide_sql(AVERAGES)})")
def exposure_wide(spark, d):
    """Every scheme's averages: the frame form of the exposure."""
    points = births(spark, d).select("cell", "from_date")
    return exposure_features(points, anomaly_grid(spark, d), ["spi1", "stdm_t"], AVERAGES, ["cell"])


SEMESTERS = [p for p in period_table() if p.scheme == "b" and p.stat == "avg"]


@query(_wide_columns(SEMESTERS), f"WITH {EXPOSURE_BASE} SELECT * FROM ({_wide_sql(SEMESTERS)})")
def exposure_pivot(spark, d):
    """The long form, pivoted under explicit names."""
    points = births(spark, d).select("cell", "from_date")
    values = ["spi1", "stdm_t"]
    long = period_exposure(points, anomaly_grid(spark, d), values, SEMESTERS, ["cell"])
    return widen_exposure(long, ["cell", "from_date"], [p.name(v) for p in SEMESTERS for v in values])


EVENT = [p for p in period_table() if p.scheme == "b" and p.stat in ("avg", "w2")]


@query(
    "cell:i from_date:d event:i var:s period:s stat:s value:f",
    f"""WITH {GRID_SQL}, {ANOMALY_SQL}, {BIRTHS_SQL},
    points AS (SELECT DISTINCT cell, from_date, 9 + age AS event FROM births WHERE age IS NOT NULL), {WINDOW_SQL},
    period(scheme, period, stat, start, first, stop) AS (VALUES {_values_sql(EVENT)}),
    long AS (SELECT *, unnest(['spi1', 'stdm_t']) AS var, unnest([spi1, stdm_t]) AS x FROM seen),
    cut AS (SELECT *, least(stop, event) AS z, CASE WHEN stat = 'avg' THEN start ELSE least(stop, event) - 1 END AS a
            FROM long CROSS JOIN period)
    SELECT cell, from_date, event, var, period, stat, avg(CASE WHEN z >= start AND off BETWEEN a AND z THEN x END) AS value
    FROM cut WHERE off BETWEEN CASE WHEN stat = 'avg' THEN start ELSE greatest(start - 1, 0) END AND stop
    GROUP BY ALL""",
)
def exposure_until_event(spark, d):
    points = births(spark, d).filter("age IS NOT NULL").select("cell", "from_date", (F.col("age") + 9).alias("event"))
    return period_exposure(
        points, anomaly_grid(spark, d), ["spi1", "stdm_t"], EVENT, ["cell"], event_offset="event"
    )


@query(
    "id:i spi1_inutero_b_avg:f stdm_t_inutero_b_avg:f stdm_t_born_6m12m_b_avg:f",
    f"WITH {ANALYSIS_SQL} SELECT * FROM analysis WHERE stdm_t_inutero_b_avg IS NOT NULL",
)
def records_with_exposure(spark, d):
    return analysis(spark, d).filter("stdm_t_inutero_b_avg IS NOT NULL")


# --- enrichment ------------------------------------------------------------


@query(
    "id:i country:s income_group:s",
    """SELECT c_custkey AS id, n_name AS country, r_name AS income_group
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def checked_lookup_join(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"))
    nations = checked_join(people, table(spark, d, "nation"), ["n_nationkey"], "left", "m:1")
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = checked_join(nations, regions, ["n_regionkey"], "left", "m:1")
    return joined.select("id", F.col("n_name").alias("country"), F.col("r_name").alias("income_group"))


LABEL_VALUES = ", ".join(
    f"({i}, '{n}', '{CLASS_LEVEL_2[n[:2]]}', '{CLASS_LEVEL_1[n[:1]]}')" for i, n in enumerate(CLASS_LEVEL_3, 1)
)


@query(
    "id:i climate_band_3:s climate_band_2:s climate_band_1:s southern:b",
    f"""WITH raster AS (
      SELECT CAST(floor(({lat_sql("s_suppkey")} + 90) / 10) AS INT) AS i, CAST(floor(({lon_sql("s_suppkey")} + 180) / 10) AS INT) AS j,
             min(s_suppkey % 32 + 1) AS code FROM supplier GROUP BY 1, 2),
    label(code, l3, l2, l1) AS (VALUES {LABEL_VALUES})
    SELECT c_custkey AS id, l3 AS climate_band_3, l2 AS climate_band_2, l1 AS climate_band_1,
           {lat_sql("c_custkey")} < 0 AS southern
    FROM customer JOIN raster ON i = floor(({lat_sql("c_custkey")} + 90) / 10) AND j = floor(({lon_sql("c_custkey")} + 180) / 10)
    JOIN label USING (code)""",
)
def cell_lookup_join(spark, d):
    """Raster of class codes (32 is water and has no label), looked up under each point."""
    nodes = table(spark, d, "supplier").select(
        latitude("s_suppkey").alias("lat"), longitude("s_suppkey").alias("lon"), (F.col("s_suppkey") % 32 + 1).cast("int").alias("code")
    )
    raster = with_cell_index(nodes, 10.0).groupBy("lat_idx", "lon_idx").agg(F.min("code").alias("band"))
    points = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), latitude("c_custkey").alias("lat"), longitude("c_custkey").alias("lon")
    )
    found = label_codes(cell_lookup(points, raster, 10.0), "band", class_labels(spark))
    return found.select(
        "id",
        *[F.col(f"label_{i}").alias(f"climate_band_{i}") for i in (3, 2, 1)],
        southern("lat").alias("southern"),
    )


@query(
    "id:i wealth:f",
    f"""WITH node AS (
      SELECT round_even({lat_sql("s_suppkey")} / 20, 0) AS i, round_even({lon_sql("s_suppkey")} / 20, 0) AS j, avg(s_acctbal) AS wealth
      FROM supplier GROUP BY 1, 2)
    SELECT c_custkey AS id, wealth FROM customer LEFT JOIN node
     ON i = round_even({lat_sql("c_custkey")} / 20, 0) AND j = round_even({lon_sql("c_custkey")} / 20, 0)""",
)
def nearest_grid_lookup(spark, d):
    nodes = (
        table(spark, d, "supplier")
        .groupBy(
            (snap(latitude("s_suppkey"), 20.0) + F.lit(0.0)).alias("lat"), (snap(longitude("s_suppkey"), 20.0) + F.lit(0.0)).alias("lon")
        )
        .agg(F.avg("s_acctbal").alias("wealth"))
    )
    points = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), latitude("c_custkey").alias("lat"), longitude("c_custkey").alias("lon")
    )
    return nearest_cell(points, nodes, 20.0)


@query(
    "id:i distance:f right_id:i",
    f"""WITH l AS (SELECT c_custkey AS id, {lon_sql("c_custkey")} AS x, {lat_sql("c_custkey")} AS y FROM customer),
    r AS (SELECT s_suppkey AS id, {lon_sql("s_suppkey", 71)} AS x, {lat_sql("s_suppkey", 41)} AS y FROM supplier),
    near AS (
      SELECT l.id, r.id AS right_id, sqrt((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y)) AS distance
      FROM l JOIN r ON (r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y) <= 64.0000001)
    SELECT l.id, b.distance, b.right_id FROM l LEFT JOIN (
      SELECT * FROM near WHERE distance <= 8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, right_id) = 1) b
      ON l.id = b.id""",
)
def nearest_point(spark, d):
    left = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), longitude("c_custkey").alias("lon"), latitude("c_custkey").alias("lat")
    )
    right = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("right_id"), longitude("s_suppkey", 71).alias("lon"), latitude("s_suppkey", 41).alias("lat")
    )
    return nearest_within(left, right, 8.0)


@query(
    "id:i side:s shock:b",
    f"""WITH {ANALYSIS_SQL}, lim AS (
      SELECT quantile_cont(stdm_t_inutero_b_avg, 0.15) AS lo, quantile_cont(stdm_t_inutero_b_avg, 0.85) AS hi FROM analysis)
    SELECT id, CASE WHEN mother IN (SELECT mother FROM analysis WHERE age < 12 AND stdm_t_inutero_b_avg IS NOT NULL) THEN 'member' ELSE 'other' END AS side,
           coalesce(stdm_t_inutero_b_avg < lo OR stdm_t_inutero_b_avg > hi, false) AS shock
    FROM analysis, lim WHERE stdm_t_inutero_b_avg IS NOT NULL""",
)
def semi_anti_members(spark, d):
    wanted = ["id", "mother", "age", "stdm_t_inutero_b_avg"]
    records = materialize(analysis(spark, d).filter("stdm_t_inutero_b_avg IS NOT NULL").select(*wanted))
    marked = outside_quantiles(records, "stdm_t_inutero_b_avg", 0.15, 0.85, "shock")
    member, other = semi_anti_split(marked, records.filter("age < 12"), ["mother"])
    return member.withColumn("side", F.lit("member")).unionByName(other.withColumn("side", F.lit("other")))


# --- features --------------------------------------------------------------

SIZE_EDGES, SIZE_LABELS = [0, 7, 13, 35, float("inf")], ["low", "middle", "high", "open"]


def _age_sql() -> str:
    out = []
    for scheme, (edges, labels) in AGE_BINS.items():
        for a, b, label in zip(edges, edges[1:], labels):
            upper = "" if b == float("inf") else f" AND filled < {b}"
            out.append(f'CASE WHEN filled >= {a}{upper} THEN 1000 ELSE 0 END AS "age_{scheme}_{label}"')
    return ", ".join(out)


AGE_COLUMNS = [f"age_{scheme}_{label}" for scheme, (_, labels) in AGE_BINS.items() for label in labels]


@query(
    "id:i " + " ".join(f"{c}:i" for c in AGE_COLUMNS),
    f"WITH {BIRTHS_SQL} SELECT id, {_age_sql()} FROM (SELECT *, coalesce(age, 1000) AS filled FROM births)",
)
def age_bins(spark, d):
    return age_dummies(births(spark, d), "age")


@query(
    "id:i size_bin:s p_size_squ:i p_size_cub:i fan:b",
    """SELECT p_partkey AS id, CASE WHEN p_size > 0 AND p_size <= 7 THEN 'low' WHEN p_size > 7 AND p_size <= 13 THEN 'middle'
           WHEN p_size > 13 AND p_size <= 35 THEN 'high' WHEN p_size > 35 THEN 'open' END AS size_bin,
           p_size * p_size AS p_size_squ, p_size * p_size * p_size AS p_size_cub,
           coalesce(CASE WHEN p_type = 'SMALL' THEN 'Yes' WHEN p_type = 'ECONOMY' THEN 'No' END = 'Yes', false) AS fan
    FROM part""",
)
def interval_bins(spark, d):
    answer = F.when(F.col("p_type") == "SMALL", "Yes").when(F.col("p_type") == "ECONOMY", "No")
    parts = add_powers(table(spark, d, "part"), ["p_size"])
    return parts.select(
        F.col("p_partkey").alias("id"),
        interval_bin("p_size", SIZE_EDGES, SIZE_LABELS).alias("size_bin"),
        "p_size_squ",
        "p_size_cub",
        yes_flag(answer).alias("fan"),
    )


DAY_SQL = """SELECT cell, month, count(*) FILTER (top >= 150) AS hot, count(*) FILTER (low < 1) AS cold FROM (
      SELECT user_id AS cell, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(ts AS DATE) AS day, max(value) AS top, min(value) AS low
      FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(
    "cell:i month:d hot:i hot_bin10:i hot_bin20:i hot_bin30:i cold:i cold_bin10:i cold_bin20:i cold_bin30:i",
    f"""SELECT *, CAST(hot >= 1 AND hot < 10 AS INT) AS hot_bin10, CAST(hot >= 10 AND hot < 20 AS INT) AS hot_bin20,
           CAST(hot >= 20 AND hot < 30 AS INT) AS hot_bin30, CAST(cold >= 1 AND cold < 10 AS INT) AS cold_bin10,
           CAST(cold >= 10 AND cold < 20 AS INT) AS cold_bin20, CAST(cold >= 20 AND cold < 30 AS INT) AS cold_bin30
    FROM ({DAY_SQL})""",
)
def day_counts(spark, d):
    """Days of a month with an extreme value, and their range dummies."""
    days = (
        table(spark, d, "events")
        .groupBy(F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("day"))
        .agg(F.max("value").alias("top"), F.min("value").alias("low"))
    )
    months = days.groupBy("cell", F.trunc("day", "month").alias("month")).agg(
        F.count_if(F.col("top") >= 150).alias("hot"), F.count_if(F.col("low") < 1).alias("cold")
    )
    return months.withColumns(day_count_bins("hot") | day_count_bins("cold"))


def _bin_sql(k: int, source: str = "e") -> str:
    steps = " + ".join(f"CASE WHEN v > {source}[{i + 1}] THEN 1 ELSE 0 END" for i in range(1, k))
    return f"1 + {steps}"


@query(
    "id:i tertile:i quintile:i decile:i zone_half:i",
    f"""WITH v AS (SELECT c_custkey AS id, c_mktsegment AS zone, c_acctbal AS v FROM customer),
    a AS (SELECT quantile_cont(v, [i / 3.0 FOR i IN range(4)]) AS e3, quantile_cont(v, [i / 5.0 FOR i IN range(6)]) AS e5,
                 quantile_cont(v, [i / 10.0 FOR i IN range(11)]) AS e10 FROM v),
    z AS (SELECT zone, quantile_cont(v, [0, 0.5, 1]) AS e2 FROM v GROUP BY 1)
    SELECT id, {_bin_sql(3, "e3")} AS tertile, {_bin_sql(5, "e5")} AS quintile, {_bin_sql(10, "e10")} AS decile,
           {_bin_sql(2, "e2")} AS zone_half
    FROM v JOIN z USING (zone) CROSS JOIN a""",
)
def quantile_bins(spark, d):
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("zone"), F.col("c_acctbal").alias("v")
    )
    for k, name in ((3, "tertile"), (5, "quintile"), (10, "decile")):
        people = quantile_bin(people, "v", k, name)
    return quantile_bin(people, "v", 2, "zone_half", ["zone"])


@query(
    "n_types:i kept:i",
    """SELECT CASE WHEN max(abs(o_orderkey % 100)) < 2147483648 THEN 1 ELSE 0 END + CASE WHEN max(abs(o_orderkey % 20000)) < 2147483648 THEN 1 ELSE 0 END
              + CASE WHEN max(abs(o_custkey)) < 2147483648 THEN 1 ELSE 0 END + CASE WHEN any_value(typeof(o_totalprice)) <> 'FLOAT' THEN 1 ELSE 0 END AS n_types,
              count(*) AS kept FROM orders""",
)
def narrowed_columns(spark, d):
    """Casts chosen from the value ranges; the values themselves stay."""
    lines = table(spark, d, "orders").select(
        (F.col("o_orderkey") % 100).alias("a"), (F.col("o_orderkey") % 20000).alias("b"), F.col("o_custkey").cast("long").alias("c"),
        F.col("o_totalprice").alias("e"), F.col("o_orderkey").alias("key"),
    )
    small = narrow_types(lines, ["a", "b", "c", "e"])
    changed = sum(t != u for (_, t), (_, u) in zip(lines.dtypes, small.dtypes))
    same = (F.col("a") == F.col("key") % 100) & (F.col("b") == F.col("key") % 20000)
    return small.agg(F.count_if(same).alias("kept")).withColumn("n_types", F.lit(changed))


@query(
    "name:s sort_key:s",
    """SELECT DISTINCT name, list_aggregate(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'),
             lambda x: CASE WHEN regexp_matches(x, '^\\d')
               THEN lpad(CAST(length(CAST(CAST(x AS BIGINT) AS VARCHAR)) AS VARCHAR), 4, '0') || CAST(CAST(x AS BIGINT) AS VARCHAR)
               ELSE x END), 'string_agg', '|') AS sort_key
    FROM (SELECT p_brand || '_w' || p_size || '.tex' AS name FROM part)""",
)
def natural_order(spark, d):
    names = table(spark, d, "part").select(F.concat("p_brand", F.lit("_w"), "p_size", F.lit(".tex")).alias("name")).distinct()
    return names.select("name", F.array_join(natural_key("name"), "|").alias("sort_key"))


# --- diagnostics -----------------------------------------------------------


@query(
    "threshold:i cells:i share:f",
    f"""WITH {BIRTHS_SQL}, c AS (SELECT cell, birth_date, count(*) AS n FROM births GROUP BY 1, 2)
    SELECT t AS threshold, count(*) FILTER (n < t) AS cells, CAST(count(*) FILTER (n < t) AS DOUBLE) / count(*) AS share
    FROM c, (VALUES (5), (10), (20), (30), (40), (50), (100)) AS v(t) GROUP BY 1""",
)
def sparse_cell_months(spark, d):
    return sparse_cells(births(spark, d), ["cell"], "birth_date")


@query(
    "column:s n:i mean:f sd:f min:f p25:f p50:f p75:f max:f",
    """SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS "column", unnest([n1, n2, n3]) AS n, unnest([a1, a2, a3]) AS mean,
           unnest([s1, s2, s3]) AS sd, unnest([i1, i2, i3]) AS min, unnest([q1[1], q2[1], q3[1]]) AS p25,
           unnest([q1[2], q2[2], q3[2]]) AS p50, unnest([q1[3], q2[3], q3[3]]) AS p75, unnest([x1, x2, x3]) AS max
    FROM (SELECT count(l_quantity) n1, avg(l_quantity) a1, stddev_samp(l_quantity) s1, min(l_quantity) i1, max(l_quantity) x1,
                 quantile_cont(l_quantity, [0.25, 0.5, 0.75]) q1,
                 count(l_extendedprice) n2, avg(l_extendedprice) a2, stddev_samp(l_extendedprice) s2, min(l_extendedprice) i2,
                 max(l_extendedprice) x2, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) q2,
                 count(l_discount) n3, avg(l_discount) a3, stddev_samp(l_discount) s3, min(l_discount) i3, max(l_discount) x3,
                 quantile_cont(l_discount, [0.25, 0.5, 0.75]) q3 FROM lineitem)""",
)
def describe_columns(spark, d):
    return describe_table(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "column:s x:f density:f6 mean:f sd:f",
    """WITH v AS (SELECT l_quantity AS q FROM lineitem), s AS (SELECT count(q) AS n, avg(q) AS m, stddev_samp(q) AS sd FROM v)
    SELECT 'l_quantity' AS "column", CAST(i AS DOUBLE) * 2.5 AS x,
           avg(exp(-power(i * 2.5 - q, 2) / (2 * power(sd * power(n, -0.2), 2)))) / (any_value(sd * power(n, -0.2)) * sqrt(2 * pi())) AS density,
           any_value(m) AS mean, any_value(sd) AS sd
    FROM v, s, range(0, 25) AS g(i) GROUP BY i""",
)
def density_curve(spark, d):
    return density_table(table(spark, d, "lineitem"), ["l_quantity"], 0.0, 60.0, 25)


@query(
    "flag:s column:s bin:i n:i",
    """SELECT l_returnflag AS flag, "column", CASE WHEN v < 5 THEN 0 WHEN v > 45 THEN 9 WHEN v = 45 THEN 8 ELSE CAST(floor((v - 5) / 5.0) AS INTEGER) + 1 END AS bin, count(*) AS n
    FROM (SELECT l_returnflag, 'l_quantity' AS "column", CAST(l_quantity AS DOUBLE) AS v FROM lineitem
          UNION ALL SELECT l_returnflag, 'l_discount', CAST(l_discount AS DOUBLE) * 400 FROM lineitem) GROUP BY ALL""",
)
def histogram_counts(spark, d):
    """Counts of two columns by group, in one aggregate."""
    lines = table(spark, d, "lineitem").withColumn("l_discount", F.col("l_discount").cast("double") * 400)
    return histogram(lines, ["l_quantity", "l_discount"], 5.0, 45.0, 8, ["l_returnflag"]).withColumnRenamed("l_returnflag", "flag")


@query(
    "column:s x:f density:f6 bound:f6",
    """WITH v AS (SELECT CAST(l_quantity AS DOUBLE) AS q FROM lineitem), s AS (SELECT stddev_samp(q) * power(count(q), -0.2) AS h, count(q) AS total FROM v),
    b AS (SELECT CASE WHEN q = 60 THEN 240 ELSE floor(q / 0.25) + 1 END AS bin, count(*) AS n FROM v WHERE q BETWEEN 0 AND 60 GROUP BY 1)
    SELECT 'l_quantity' AS "column", i * 2.5::DOUBLE AS x,
           sum(n * exp(-power((i * 2.5::DOUBLE - (bin - 0.5) * 0.25) / h, 2) / 2)) / (any_value(total) * any_value(h) * sqrt(2 * pi())) AS density,
           0.125 * 0.242 / power(any_value(h), 2) AS bound
    FROM b, s, range(0, 25) AS g(i) GROUP BY i""",
)
def binned_density_curve(spark, d):
    """Kernel sums over bins, which no longer depend on the number of rows."""
    return binned_density(table(spark, d, "lineitem"), ["l_quantity"], 0.0, 60.0, 25, 240)


@query(
    "flag:s n:i close:b",
    "SELECT l_returnflag AS flag, count(l_extendedprice) AS n, true AS close FROM lineitem GROUP BY 1",
)
def quantile_sketch(spark, d):
    """Sketches of two batches, stored and merged; their quartiles by rank among all values."""
    values = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"), "l_linenumber")
    parts = [materialize(quantile_sketches(values.filter(c), ["flag"])) for c in ("l_linenumber <= 2", "l_linenumber > 2")]
    found = sketch_quantiles(merged_sketches(parts[0].unionByName(parts[1]), ["flag"]), ["flag"], [0.25, 0.5, 0.75])
    near = [
        (F.avg((F.col("v") < F.col("edges")[i]).cast("double")) <= p + 0.0167) & (F.avg((F.col("v") <= F.col("edges")[i]).cast("double")) >= p - 0.0167)
        for i, p in enumerate((0.25, 0.5, 0.75))
    ]
    return skew_join(values, found, ["flag"]).groupBy("flag", "n").agg((near[0] & near[1] & near[2]).alias("close"))


@query(
    "cell:i month:d change:f",
    f"""WITH {GRID_SQL}, n AS (SELECT *, year(month) * 12 + month(month) AS i, avg(tp) OVER (PARTITION BY cell) AS mean FROM grid)
    SELECT a.cell, a.month, (a.tp - b.tp) / a.mean AS change FROM n a LEFT JOIN n b ON a.cell = b.cell AND b.i = a.i - 5""",
)
def applied_series(spark, d):
    """A user function over whole series: the change over five calendar months, in means of the cell."""

    def change(values):
        out = np.full(len(values), np.nan)
        out[5:] = values[5:] - values[:-5]
        return out / np.nanmean(values)

    return apply_series(grid_coarse(spark, d), "tp", change, "change", ["cell"])


@query(
    "column:s mean:f",
    f"""WITH {BIRTHS_SQL} SELECT unnest(['age_biannual_1m6m', 'age_biannual_6m12m', 'age_biannual_12m18m']) AS "column",
           unnest([avg(CASE WHEN age < 6 THEN 1000 ELSE 0 END), avg(CASE WHEN age >= 6 AND age < 12 THEN 1000 ELSE 0 END),
                   avg(CASE WHEN age >= 12 AND age < 18 THEN 1000 ELSE 0 END)]) AS mean FROM births""",
)
def rates_per_thousand(spark, d):
    dummies = age_dummies(births(spark, d), "age", ["biannual"])
    return column_means(dummies, ["age_biannual_1m6m", "age_biannual_6m12m", "age_biannual_12m18m"])


@query(
    "kind:s n:i",
    f"""WITH {BIRTHS_SQL}
    SELECT 'points' AS kind, count(DISTINCT (cell, from_date)) AS n FROM births UNION ALL
    SELECT zone, count(*) FROM births GROUP BY 1 UNION ALL
    SELECT 'zones', count(DISTINCT zone) FROM births""",
)
def row_audit(spark, d):
    records = births(spark, d)
    points = distinct_count(records, ["cell", "from_date"]).select(F.lit("points").alias("kind"), "n")
    zones = distinct_values(records, "zone").agg(F.count("*").alias("n")).select(F.lit("zones").alias("kind"), "n")
    return points.unionByName(frequency(records, "zone").withColumnRenamed("zone", "kind")).unionByName(zones)
