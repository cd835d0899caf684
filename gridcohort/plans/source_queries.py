"""Queries over sources and sinks: given tables are written in a format, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.exposure import exposure_features
from ..operators.features import narrow_types, select_features
from ..operators.quality import CheckedWrite, audit, checked_rows, distinct_values, nonzero_mean, one_of, sample_rows, validate
from ..session import ensure_checkpoint_dir
from ..sources.reports import ingest_reports, read_reports, report_body
from ..sources.tables import append_csv, ensure_table, read_columns, read_csv_folder, read_lookup, read_series, scan_series, write_banded, write_series, write_table
from .model_queries import ESTIMATES_SQL, STARS_SQL, TERMS, COEFS_SQL, _coefs, _estimates, _report_lines
from .record_queries import AVERAGES, EXPOSURE_BASE, _wide_columns, _wide_sql
from .registry import query
from .roles import GRID_SQL, anomaly_grid, births, grid_coarse, lat_sql, latitude, table
from .specs import write_coefficients


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for this query's files, where all executors can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(
    "year:i orders:i total:f urgent:i",
    """SELECT year(o_orderdate) AS year, count(*) AS orders, sum(o_totalprice) AS total,
              CASE WHEN year(o_orderdate) >= 1995 THEN count(*) FILTER (o_orderpriority = '1-URGENT') END AS urgent
       FROM orders GROUP BY 1""",
)
def yearly_series(spark, d):
    """Yearly files of one series; the later ones have a column more."""
    path = folder(spark, "series")
    orders = table(spark, d, "orders").select("o_orderdate", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    early = F.year("o_orderdate") < 1995
    orders.filter(early).drop("urgent").write.parquet(path)
    write_table(orders.filter(~early), path, "append")
    whole = read_series(spark, path)
    return whole.groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("orders"), F.sum("price").alias("total"), F.sum(F.col("urgent").cast("int")).alias("urgent")
    )


@query(
    "l_returnflag:s l_quantity:f n:i width:i",
    "SELECT l_returnflag, sum(l_quantity) AS l_quantity, count(*) AS n, 3 AS width FROM lineitem GROUP BY 1",
)
def chosen_columns(spark, d):
    """A scan without the unwanted columns."""
    lines = read_columns(spark, f"{d}/lineitem.parquet", lambda c: c not in ("l_returnflag", "l_quantity", "l_shipdate"))
    return lines.groupBy("l_returnflag").agg(F.sum("l_quantity").alias("l_quantity"), F.count("*").alias("n"), F.lit(len(lines.columns)).alias("width"))


@query(
    "id:i segment:s balance:f",
    "SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
)
def csv_folder(spark, d):
    """A folder of CSV files, added to in two steps; other files in it are not read."""
    path = folder(spark, "csv")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("double").alias("balance"))
    append_csv(people.filter("id % 3 = 0"), path)
    append_csv(people.filter("id % 3 <> 0"), path)
    write_table(people.limit(1), path, "append")
    return read_csv_folder(spark, path, "id long, segment string, balance double")


@query("code:i country:s", "SELECT n_nationkey AS code, n_name AS country FROM nation")
def csv_lookup(spark, d):
    path = folder(spark, "lookup")
    table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name").write.option("header", "true").csv(path)
    return read_lookup(spark, path, "n_nationkey long, n_regionkey long, n_name string", {"n_nationkey": "code", "n_name": "country"}, ["code", "country"])


@query(
    "band:i records:i south:f north:f",
    f"""SELECT CAST(floor(lat / 5) AS INTEGER) AS band, count(*) AS records, min(lat) AS south, max(lat) AS north
    FROM (SELECT {lat_sql("c_custkey")} AS lat FROM customer) WHERE floor(lat / 5) BETWEEN -2 AND 4 GROUP BY 1""",
)
def banded_table(spark, d):
    """A table by latitude band, of which some bands are read."""
    path = folder(spark, "bands")
    write_banded(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), latitude("c_custkey").alias("lat")), path)
    some = spark.read.parquet(path).filter("lat_band BETWEEN -2 AND 4")
    return some.groupBy(F.col("lat_band").alias("band")).agg(F.count("*").alias("records"), F.min("lat").alias("south"), F.max("lat").alias("north"))


@query("status:s n:i builds:i", "SELECT o_orderstatus AS status, count(*) AS n, 1 AS builds FROM orders GROUP BY 1")
def ensured_table(spark, d):
    """Built at the first call, read at the second."""
    path, built = folder(spark, "ensured"), []

    def build() -> DataFrame:
        built.append(1)
        return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))

    ensure_table(spark, path, build)
    return ensure_table(spark, path, build).withColumn("builds", F.lit(len(built)))


@query(
    "spec_id:s term:s n:i place:i",
    f"""WITH {COEFS_SQL} SELECT spec_id, term, sum(n) AS n,
       max(CASE term WHEN '{TERMS[3]}' THEN 1 WHEN '{TERMS[1]}' THEN 2 ELSE 3 END) AS place FROM coefs GROUP BY 1, 2""",
)
def result_sink(spark, d):
    """The result table with its order of terms."""
    path = folder(spark, "results")
    write_coefficients(_coefs(spark, d), path, [TERMS[3], TERMS[1]])
    return spark.read.parquet(path).groupBy("spec_id", "term").agg(F.sum("n").alias("n"), F.max("term_order").alias("place"))


@query(
    "file:s term:s outcome:i cell_level:i coef:f se:f n_stars:i",
    f"""WITH {ESTIMATES_SQL} SELECT 'report_' || nation || '.tex' AS file, term, col // 3 AS outcome, col % 3 + 1 AS cell_level,
       m / 1000.0::DOUBLE AS coef, s / 1000.0::DOUBLE AS se, {STARS_SQL} AS n_stars FROM est WHERE term_no < 7""",
)
def report_files(spark, d):
    """Reports as text files, one folder entry each, with a header and a footer that look like rows, and a last line end."""
    path = folder(spark, "reports")
    lines = _report_lines(spark, d).select("file", (F.col("line_no") + 1).alias("line_no"), "text")
    mark = lines.select("file").distinct()
    ends = [mark.select("file", F.lit(i).alias("line_no"), F.lit(r"stdm\_t\_header & 9.9*** & 9.9 \\").alias("text")) for i in (0, 1000)]
    whole = lines.unionByName(ends[0]).unionByName(ends[1]).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    text = whole.select("file", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("value"))
    text.repartition("file").write.partitionBy("file").text(path)
    named = read_reports(spark, path, "*.txt").withColumn("file", F.regexp_extract("file", "^file=([^/]+)/", 1))
    return ingest_reports(report_body(named, 1, 2)).filter("coef IS NOT NULL")


QUARTER_TERMS = [f"stdm_t_born_1m6m_b_avg_q{i}_int" for i in (1, 2, 3, 4)]


@query(
    "file:s term:s outcome:i cell_level:i coef:f se:f",
    f"""WITH {ESTIMATES_SQL} SELECT 'report_' || nation || '.tex' AS file, 'stdm_t_born_1m6m_b_avg_q' || term_no || '_int' AS term,
       col // 3 AS outcome, col % 3 + 1 AS cell_level, m / 1000.0::DOUBLE AS coef,
       CASE WHEN nation % 3 > 0 OR col < 5 THEN s / 1000.0::DOUBLE END AS se
    FROM est WHERE term_no BETWEEN 1 AND 4 AND NOT (nation % 2 = 0 AND col = 2)""",
)
def spline_report_ingest(spark, d):
    """Reports of spline models: empty cells, and rows of errors that end early."""
    est = _estimates(spark, d).filter("term_no BETWEEN 1 AND 4")
    gap = (F.col("nation") % 2 == 0) & (F.col("col") == 2)
    coef = F.when(~gap, F.format_string("%.3f", F.col("m") / 1000.0))
    error = F.when(~gap & ((F.col("nation") % 3 > 0) | (F.col("col") < 5)), F.format_string("(%.3f)", F.col("s") / 1000.0))
    wide = est.groupBy("nation", "term_no").agg(
        *[F.max(F.when(F.col("col") == i, coef)).alias(f"e{i}") for i in range(6)], *[F.max(F.when(F.col("col") == i, error)).alias(f"s{i}") for i in range(6)]
    )
    names = F.array(*[F.lit(t.replace("_", r"\_")) for t in QUARTER_TERMS])
    row = lambda head, kind: F.concat(F.concat_ws(" & ", head, *[F.coalesce(f"{kind}{i}", F.lit("")) for i in range(6)]), F.lit(r" \\"))
    lines = F.array(
        F.struct((F.col("term_no") * 2).cast("int").alias("line_no"), row(F.element_at(names, F.col("term_no").cast("int")), "e").alias("text")),
        F.struct((F.col("term_no") * 2 + 1).cast("int").alias("line_no"), row(F.lit(" "), "s").alias("text")),
    )
    printed = wide.select(F.concat(F.lit("report_"), "nation", F.lit(".tex")).alias("file"), F.explode(lines).alias("l")).select("file", "l.*")
    return ingest_reports(printed).filter("coef IS NOT NULL")


@query(
    "column:s type:s total:i",
    """SELECT * FROM (VALUES ('a', 'tinyint', (SELECT sum(o_orderkey % 100) FROM orders)), ('b', 'smallint', (SELECT sum(o_orderkey % 20000) FROM orders)),
       ('c', (SELECT CASE WHEN max(o_custkey) <= 127 THEN 'tinyint' WHEN max(o_custkey) <= 32767 THEN 'smallint' ELSE 'int' END FROM orders), (SELECT sum(o_custkey) FROM orders)),
       ('e', 'float', (SELECT sum(o_orderkey % 7) FROM orders))) AS v("column", type, total)""",
)
def narrowed_types(spark, d):
    """The chosen types by name and the sums of the values."""
    wide = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("a"), (F.col("o_orderkey") % 20000).alias("b"), F.col("o_custkey").cast("long").alias("c"), (F.col("o_orderkey") % 7).cast("double").alias("e"))
    small = narrow_types(wide, list("abce"))
    types = dict(small.dtypes)
    sums = small.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in types])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("total")) for c, t in types.items()])).alias("r")).select("r.*")


QUARTERLY_AVERAGES = [p for p in AVERAGES if p.scheme == "q"]


@query(_wide_columns(QUARTERLY_AVERAGES, ["stdm_t"]), f"WITH {EXPOSURE_BASE} SELECT * FROM ({_wide_sql(QUARTERLY_AVERAGES, ['stdm_t'])})")
def selected_features(spark, d):
    """Exposure columns picked by the parts of their names."""
    points = births(spark, d).select("cell", "from_date")
    wide = exposure_features(points, anomaly_grid(spark, d), ["spi1", "stdm_t"], AVERAGES, ["cell"])
    return select_features(wide, ["stdm_t"], "q", "avg", plus=["cell", "from_date"])


@query(
    "segment:s odd:i n:i",
    "SELECT c_mktsegment AS segment, c_custkey % 2 AS odd, count(*) AS n FROM customer GROUP BY 1, 2",
)
def validated_records(spark, d):
    """A table that passes its checks; one that doesn't is refused."""
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_custkey") % 2).alias("odd"))
    validate(people, {"odd is set": nonzero_mean("odd"), "five segments": F.count_distinct("c_mktsegment") == distinct_values(people, "c_mktsegment").count()}, ["c_custkey"])
    try:
        validate(people, {"all odd": F.min("odd") == 1}, ["c_custkey"])
    except ValueError as refused:
        one_of(str(refused), ["all odd", "no rows"])
        return people.groupBy(F.col("c_mktsegment").alias("segment"), "odd").agg(F.count("*").alias("n"))
    raise ValueError("a failed check passed")


@query(
    "segment:s n:i balance:f passed:i",
    """SELECT c_mktsegment AS segment, count(*) AS n, sum(c_acctbal) AS balance, (SELECT count(*) FILTER (c_acctbal IS NOT NULL) FROM customer) AS passed
       FROM customer GROUP BY 1""",
)
def checked_write(spark, d):
    """Row checks in the plan and aggregate checks while writing: one reading of the records."""
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    sound = checked_rows(people, {"a key": F.col("c_custkey") >= 0, "a segment": F.col("c_mktsegment").isNotNull()}, "c_custkey")
    path = folder(spark, "checked")
    got = CheckedWrite(sound, {"balances": F.count("c_acctbal") > 0, "keys differ": F.max("c_custkey") > F.min("c_custkey")}).to(path)
    try:
        CheckedWrite(people, {"all poor": F.max("c_acctbal") < 0}).to(f"{path}-refused")
    except ValueError:
        out = spark.read.parquet(path).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"))
        return out.withColumn("passed", F.lit(got["rows"]))
    raise ValueError("a failed check passed")


@query("status:s n:i rows_seen:i", "SELECT o_orderstatus AS status, count(*) AS n, (SELECT count(*) FROM orders) AS rows_seen FROM orders GROUP BY 1")
def audited_records(spark, d):
    """Rows counted as they pass into a table."""
    counted, seen = audit(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), f"orders-{uuid.uuid4().hex[:8]}")
    path = folder(spark, "audited")
    write_table(counted, path)
    out = spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return out.withColumn("rows_seen", F.lit(seen.get["rows"]))


@query(
    "file:s term:s outcome:i cell_level:i coef:f se:f",
    f"""WITH {ESTIMATES_SQL} SELECT 'report_' || nation || '.tex' AS file, term, col // 3 AS outcome, col % 3 + 1 AS cell_level,
       m / 1000.0::DOUBLE AS coef, s / 1000.0::DOUBLE AS se FROM est WHERE term_no < 7""",
)
def checked_ingest(spark, d):
    """Reports whose rows have as many errors as coefficients; another one ends the job."""
    lines = _report_lines(spark, d)
    short = lines.withColumn("text", F.when(F.col("line_no") == 3, F.regexp_replace("text", " & [^&]*$", "")).otherwise(F.col("text")))
    try:
        ingest_reports(short, strict=True).write.format("noop").mode("overwrite").save()
    except Exception as refused:
        if "as many errors as coefficients" not in str(refused):
            raise
        return ingest_reports(lines, strict=True).filter("coef IS NOT NULL")
    raise ValueError("a malformed report passed")


@query(
    "cell:i month:d tp:f t2m:f",
    f"WITH {GRID_SQL} SELECT * FROM grid WHERE month BETWEEN DATE '1994-03-01' AND DATE '1996-10-01'",
)
def pruned_series(spark, d):
    """Some months of a series in yearly folders; only their years are opened."""
    path = folder(spark, "years")
    write_series(grid_coarse(spark, d), path)
    return scan_series(spark, path, "cell long, month date, tp double, t2m double", "1994-03-01", "1996-10-01")


@query(
    "c_custkey:i c_name:s",
    "SELECT c_custkey, c_name FROM customer ORDER BY md5(concat_ws('|', '1', CAST(c_custkey AS VARCHAR), c_name)) LIMIT 100",
)
def sampled_rows(spark, d):
    """A sample of 100 rows by a seed and the row's hash."""
    return sample_rows(table(spark, d, "customer").select("c_custkey", "c_name"), 100)
