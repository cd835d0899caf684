"""Checks, summaries and diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from .quantiles import long_values, many_quantiles

THRESHOLDS = (5, 10, 20, 30, 40, 50, 100)


def validate(df: DataFrame, checks: dict[str, Column], columns: Sequence[str] = ()) -> DataFrame:
    """Raise unless the columns exist, the frame has rows and every aggregate check is true.

    One pass for all checks; returns the frame.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    row = df.agg(F.count("*").alias("rows"), *[c.alias(f"c{i}") for i, c in enumerate(checks.values())]).first()
    if row["rows"] == 0:
        raise ValueError("no rows")
    failed = [name for i, name in enumerate(checks) if not row[f"c{i}"]]
    if failed:
        raise ValueError(f"failed: {failed}")
    return df


def checked_rows(df: DataFrame, checks: dict[str, Column], label: Column | str = "row") -> DataFrame:
    """Rows as they are; the first row for which a check isn't true ends whatever job reads them.

    The checks are part of the plan, so they cost no job and no second reading. The error names the
    check and the label of the row.
    """
    shown = F.coalesce((F.col(label) if isinstance(label, str) and label in df.columns else F.lit(label) if isinstance(label, str) else label).cast("string"), F.lit("null"))
    for name, ok in checks.items():
        refused = F.raise_error(F.concat(F.lit(f"failed: {name} at "), shown)).cast("boolean")
        df = df.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(refused))
    return df


class CheckedWrite:
    """Aggregate checks that are taken while a result is written, without a job of their own.

    ``CheckedWrite(df, checks).to(path)`` writes beside the path, and moves the table there only if it
    has rows and every check is true; otherwise nothing is left at the path, and the failed checks
    are named.
    """

    def __init__(self, df: DataFrame, checks: dict[str, Column]) -> None:
        self.seen, self.names = Observation(), list(checks)
        self.df = df.observe(self.seen, F.count("*").alias("rows"), *[c.alias(f"c{i}") for i, c in enumerate(checks.values())])

    def to(self, path: str) -> dict:
        """The number of rows and the values of the checks by name."""
        from ..sources.tables import commit_table

        def passed() -> None:
            got = self.seen.get
            failed = [n for i, n in enumerate(self.names) if not got[f"c{i}"]]
            if not got["rows"] or failed:
                raise ValueError(f"failed: {failed}" if got["rows"] else "no rows")

        commit_table(self.df, path, passed)
        got = self.seen.get
        return {"rows": got["rows"], **{n: got[f"c{i}"] for i, n in enumerate(self.names)}}


def nonzero_mean(column: str) -> Column:
    """Check for a dummy that is set somewhere."""
    return F.avg(F.col(column).cast("double")) > 0


def one_of(text: str, options: Sequence[str]) -> str:
    """The only option found in a text."""
    found = [o for o in options if o in text]
    if len(found) != 1:
        raise ValueError(f"{text!r} holds {found}")
    return found[0]


def audit(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without another job; read ``observation.get['rows']`` afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows")), seen


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct(*columns)).alias("n"))
    return df.select(*columns).distinct().agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct()


def frequency(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean), long."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "mean")


def describe_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, sd, min, p25, p50, p75, max): sample deviation and exact quartiles."""
    c = {name: F.col(name).cast("double") for name in columns}
    quartiles = many_quantiles(df, c, [0.25, 0.5, 0.75])
    basic = df.agg(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
                F.min(x).alias("min"),
                *[F.lit(q).alias(p) for p, q in zip(("p25", "p50", "p75"), quartiles[name])],
                F.max(x).alias("max"),
            ).alias(f"s{i}")
            for i, (name, x) in enumerate(c.items())
        ]
    )
    return basic.select(F.explode(F.array(*basic.columns)).alias("r")).select("r.*")


def sparse_cells(df: DataFrame, cell: Sequence[str], month: str, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """(threshold, cells, share): cell-months with fewer records than each threshold."""
    counts = df.groupBy(*cell, month).agg(F.count("*").alias("n"))
    wide = counts.agg(F.count("*").alias("total"), *[F.count_if(F.col("n") < t).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("cells")) for t in thresholds])
    return wide.select("total", F.explode(rows).alias("r")).select(
        "r.threshold", "r.cells", (F.col("r.cells") / F.col("total")).alias("share")
    )


def density_table(
    df: DataFrame, columns: Sequence[str], low: float, high: float, points: int = 101, bandwidth: float | None = None
) -> DataFrame:
    """(column, x, density, mean, sd): Gaussian kernel density on an even grid, exact over all rows.

    Each grid point is one aggregate, so rows are read once and nothing is repeated per point.
    Default bandwidth: sample deviation · n^(-1/5). Where it is zero (a constant, a single or no
    value) the density is null.
    """
    step = (high - low) / (points - 1)
    at = [low + i * step for i in range(points)]
    values = {name: F.col(name).cast("double") for name in columns}
    moments = df.agg(*[F.struct(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")).alias(f"m{i}") for i, x in enumerate(values.values())]).first()
    rows = []
    for i, (name, x) in enumerate(values.items()):
        n, mean, sd = moments[f"m{i}"]
        h = bandwidth or (sd or 0.0) * n ** (-0.2) if n else None
        kernels = [F.lit(None).cast("double") if not h else F.avg(F.exp(-((F.lit(g) - x) * (F.lit(g) - x)) / (2 * h * h))) / (h * (2 * math.pi) ** 0.5) for g in at]
        rows.append(F.struct(F.lit(name).alias("column"), F.array(*kernels).alias("d"), F.lit(mean).cast("double").alias("mean"), F.lit(sd).cast("double").alias("sd")))
    grid = F.array(*[F.lit(g) for g in at])
    wide = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r"))
    return wide.select("r.column", F.explode(F.arrays_zip(grid.alias("x"), F.col("r.d").alias("d"))).alias("p"), "r.mean", "r.sd").select(
        "column", F.col("p.x").alias("x"), F.col("p.d").alias("density"), "mean", "sd"
    )


def histogram(df: DataFrame, columns: Sequence[str], low: float, high: float, bins: int, group: Sequence[str] = ()) -> DataFrame:
    """(group…, column, bin, n): counts of all columns in even bins, in one aggregate.

    Bin 0 holds what is below ``low``, bins 1 to ``bins`` are closed on the left, the last one on
    both sides, bin ``bins`` + 1 holds what is above ``high``. Null and not a number have bin null.
    """
    width = (high - low) / bins
    long = long_values(df, {c: F.col(c) for c in columns}, group)
    v = F.nanvl("v", F.lit(None).cast("double"))
    place = F.when(v < low, 0).when(v > high, bins + 1).when(v == high, bins).when(v.isNotNull(), F.floor((v - low) / F.lit(width)) + 1)
    counted = long.select(*group, F.col("name").alias("column"), place.cast("int").alias("bin"))
    return counted.groupBy(*group, "column", "bin").agg(F.count("*").alias("n"))


def binned_density(
    df: DataFrame, columns: Sequence[str], low: float, high: float, points: int = 101, bins: int = 1000, bandwidth: float | None = None
) -> DataFrame:
    """(column, x, density, bound): Gaussian kernel density of all columns from counts in even bins.

    One aggregate reads the rows, whatever the number of points; kernels are summed over the bins,
    each value standing at the middle of its bin. Values outside ``low`` to ``high`` count for the
    total and the default bandwidth (sample deviation · n^(-1/5)), but not for the curve.
    ``bound`` is the largest difference to the exact curve of the values inside: half a bin times
    the steepest slope of a kernel, 0.242 / bandwidth².
    """
    width = (high - low) / bins
    counted = histogram(df, columns, low, high, bins).filter("bin IS NOT NULL")
    long = long_values(df, {c: F.col(c) for c in columns})
    moments = long.groupBy(F.col("name").alias("column")).agg(F.count("v").alias("total"), F.stddev_samp("v").alias("sd"))
    h = F.lit(float(bandwidth)) if bandwidth else F.nullif(F.col("sd"), F.lit(0.0)) * F.pow(F.col("total").cast("double"), F.lit(-0.2))
    inside = counted.join(moments, "column").withColumn("h", h).withColumn("middle", F.lit(low) + (F.col("bin") - 0.5) * width)
    at = [low + i * (high - low) / (points - 1) for i in range(points)]
    kernel = lambda g: F.sum(F.when(F.col("bin").between(1, bins), F.col("n") * F.exp(-F.pow((F.lit(g) - F.col("middle")) / F.col("h"), F.lit(2.0)) / 2)).otherwise(0.0))
    sums = inside.groupBy("column", "total", "h").agg(F.array(*[kernel(g) for g in at]).alias("d"))
    scale = F.col("total") * F.col("h") * math.sqrt(2 * math.pi)
    return sums.select("column", "total", "h", F.explode(F.arrays_zip(F.array(*[F.lit(g) for g in at]).alias("x"), "d")).alias("p")).select(
        "column", F.col("p.x").alias("x"), (F.col("p.d") / scale).alias("density"), (F.lit(width / 2 * 0.242) / F.pow("h", F.lit(2.0))).alias("bound")
    )


def sample_rows(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n random rows, the same ones for a seed and a row set: those with the smallest hash of seed and values."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(f"`{c}`").cast("string") for c in df.columns])
    return df.orderBy(F.md5(text)).limit(n)
