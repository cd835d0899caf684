"""Printed regression tables: ``&``-separated lines with stars, standard errors on the next line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import number_text, stars
from ..operators.joins import skew_join
from ..operators.quality import checked_rows
from ..operators.results import EXTREME_PREFIXES, SPI_PREFIXES, TEMP_PREFIXES, confidence_bounds, with_term_parts

# Forms of a sample size, tried in this order.
SIZE_PATTERNS = (r"(\d+,\d+,\d+)", r"(\d+,\d+)", r"(\d+)")
KEYWORDS = "drought|excessiverain|t_|std_t|stdm_t|spi"


def read_reports(spark: SparkSession, path: str, glob: str = "*.tex") -> DataFrame:
    """(file, line_no, text) of every report in a folder and the folders below it.

    ``file`` is the path from the folder on, so reports of one name in two folders stay two.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    whole = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup="true")
    place = F.regexp_replace(F.try_url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^[^:/]+:(//[^/]*)?", "")
    return whole.select(
        F.substring(place, len(root.rstrip("/")) + 2, 1 << 30).alias("file"),
        F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"),
    )


def _fields(text: Column) -> Column:
    """Cells of a row, without line ends, escapes and blanks around."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\\\\", ""), r"\\_", "_")
    return F.transform(F.split(plain, "&"), lambda x: F.trim(F.regexp_replace(x, r"\\", "")))


def report_body(lines: DataFrame, header: int = 0, footer: int = 0) -> DataFrame:
    """Lines without the first ``header`` and the last ``footer`` ones of their file."""
    last = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    kept = skew_join(lines, last, ["file"]).filter((F.col("line_no") >= header) & (F.col("line_no") <= F.col("_last") - footer))
    return kept.drop("_last")


def ingest_reports(
    lines: DataFrame, n_levels: int = 3, drop_last: int = 0, terms: str | None = None, critical_value: float = 1.96, strict: bool = False
) -> DataFrame:
    """Coefficients (file, term, kind, key, outcome, cell_level, coef, se, lower, upper, n_stars).

    A row of a known term carries one coefficient per column; column i belongs to outcome
    ``i div n_levels`` and level ``i mod n_levels``. Standard errors come from the next line by an
    equi-join on (file, line). ``drop_last`` leaves out that many last outcomes. With ``strict`` a
    report whose coefficient rows differ in their number of cells, or from their errors, ends the job.
    """
    known = terms or "^(" + "|".join((*SPI_PREFIXES, *TEMP_PREFIXES, *EXTREME_PREFIXES)) + ")"
    cells = lines.select("file", "line_no", _fields(F.col("text")).alias("cell"))
    # The first word names the term.
    rows = cells.withColumn("term", F.split_part(F.col("cell")[0], F.lit(" "), F.lit(1))).filter(F.col("term").rlike(known))
    errors = cells.select("file", (F.col("line_no") - 1).alias("line_no"), F.col("cell").alias("error"))
    paired = rows.join(errors, ["file", "line_no"], "left").withColumn(
        "outcomes", F.floor((F.size("cell") - 1) / F.lit(n_levels)).cast("int")
    )
    if strict:
        length = Window.partitionBy("file").orderBy("line_no")
        paired = paired.withColumn("_cells", F.first(F.size("cell")).over(length))
        place = F.concat_ws(":", "file", "line_no")
        paired = checked_rows(
            paired,
            {"as many cells in every row": F.size("cell") == F.col("_cells"), "as many errors as coefficients": F.size("error") == F.size("cell")},
            place,
        ).drop("_cells")
    values = paired.select(
        "file",
        "line_no",
        "term",
        "outcomes",
        "error",
        F.posexplode(F.slice("cell", 2, F.greatest(F.size("cell") - 1, F.lit(0)))).alias("i", "printed"),
    )
    read = values.select(
        "file",
        "term",
        F.floor(F.col("i") / n_levels).cast("int").alias("outcome"),
        (F.col("i") % n_levels + 1).alias("cell_level"),
        number_text("printed").alias("coef"),
        number_text(F.get("error", F.col("i") + 1)).alias("se"),
        stars("printed").alias("n_stars"),
        "outcomes",
    ).filter(F.col("outcome") < F.col("outcomes") - drop_last)
    return with_term_parts(confidence_bounds(read.drop("outcomes"), critical_value))


def sample_sizes(lines: DataFrame) -> DataFrame:
    """(file, n) from the first ``$N$`` row: a number in the millions, else thousands, else any."""
    rows = lines.filter(F.col("text").rlike(r"\$N\$\s*&"))
    first = rows.groupBy("file").agg(F.min(F.struct("line_no", "text")).alias("r"))
    text = F.col("r.text")
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in SIZE_PATTERNS]
    return first.select("file", F.regexp_replace(F.coalesce(*found), ",", "").cast("long").alias("n"))


def star_counts(lines: DataFrame, keywords: str = KEYWORDS) -> DataFrame:
    """Per file and column: estimates, and starred ones at three levels by sign, as printed."""
    cells = lines.select("file", F.split(F.regexp_replace("text", r"\\_", "_"), "&").alias("cell"))
    named = cells.filter((F.trim(F.col("cell")[0]) != "") & F.col("cell")[0].rlike(keywords))
    values = named.select("file", F.posexplode(F.slice("cell", F.lit(2), F.size("cell"))).alias("specification", "v")).withColumn(
        "v", F.trim(F.regexp_replace("v", r"\\\\", ""))
    )
    n, negative = stars("v"), F.col("v").rlike(r"-.*\.")
    counts = [F.count_if(F.col("v") != "").alias("estimates")]
    for k, level in ((1, "p10"), (2, "p05"), (3, "p01")):
        counts.append(F.count_if((n >= k) & ~negative).alias(f"{level}_pos"))
        counts.append(F.count_if((n >= k) & negative).alias(f"{level}_neg"))
    return values.groupBy("file", "specification").agg(*counts)
