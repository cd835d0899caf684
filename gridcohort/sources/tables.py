"""Reading and writing tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.columns import clean_nans
from ..operators.joins import TARGET_ROWS, hot_parts


def _known(df: DataFrame) -> DataFrame:
    return clean_nans(df, [c for c, kind in df.dtypes if kind in ("float", "double")])


def read_series(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """Every Parquet file below a folder as one series; files may differ in their columns. NaN reads as null."""
    reader = spark.read.option("recursiveFileLookup", "false")
    if schema is not None:
        return _known(reader.schema(schema).parquet(folder))
    return _known(reader.option("mergeSchema", "true").parquet(folder))


def read_columns(spark: SparkSession, path: str, drop: Callable[[str], bool] | Sequence[str]) -> DataFrame:
    """All columns but the unwanted ones; only the kept ones are read from the file. NaN reads as null."""
    df = spark.read.parquet(path)
    unwanted = drop if callable(drop) else set(drop).__contains__
    return _known(df.select(*[c for c in df.columns if not unwanted(c)]))


def read_csv_folder(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All ``*.csv`` files of a folder, columns matched to the header by name."""
    return spark.read.option("header", "true").option("enforceSchema", "false").option("pathGlobFilter", "*.csv").schema(
        schema
    ).csv(folder)


def read_lookup(
    spark: SparkSession, path: str, schema: StructType | str, rename: dict[str, str] | None = None, keep: Sequence[str] | None = None
) -> DataFrame:
    """A small CSV table with renamed and chosen columns."""
    df = spark.read.option("header", "true").schema(schema).csv(path).withColumnsRenamed(rename or {})
    return df.select(*keep) if keep else df


def with_lat_band(df: DataFrame, lat: str = "lat", width: float = 5.0) -> DataFrame:
    return df.withColumn("lat_band", F.floor(F.col(lat) / F.lit(width)).cast("int"))


def write_banded(df: DataFrame, path: str, lat: str = "lat", width: float = 5.0, rows: int = TARGET_ROWS) -> None:
    """Parquet by latitude band, so that a latitude filter reads only its bands.

    A band is written by as many tasks as it has multiples of ``rows`` rows, spread by a hash of
    the row: a populous band does not end in one task.
    """
    banded = with_lat_band(df, lat, width)
    parts = banded.join(hot_parts(banded, ["lat_band"], rows), "lat_band", "left")
    spread = F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1)))
    parts.repartition("lat_band", spread).drop("_parts").sortWithinPartitions("lat_band", lat).write.mode("overwrite").partitionBy(
        "lat_band"
    ).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with zstd; ``mode='append'`` adds to a table under its one schema."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def commit_table(df: DataFrame, path: str, before: Callable[[], None] | None = None) -> bool:
    """Write a table beside the path, then give it its name in one step. False if another writer was first.

    Readers see the whole table or none. ``before`` is called when the files are written; if it
    raises, they are removed and the path stays as it was. The one who is late removes its own files.
    """
    spark = df.sparkSession
    target, files = _path(spark, path)
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    source, _ = _path(spark, staged)
    try:
        write_table(df, staged, "errorifexists")
        if before:
            before()
        if files.exists(target):
            return False
        # Renaming a folder fails where the name is taken, or, in some stores, puts it inside.
        won = files.rename(source, target)
        inside, _ = _path(spark, f"{path.rstrip('/')}/{staged.rsplit('/', 1)[-1]}")
        if files.exists(inside):
            files.delete(inside, True)
            return False
        return bool(won)
    finally:
        if files.exists(source):
            files.delete(source, True)


def ensure_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built first if it isn't there.

    Several drivers may call this at once: each builds beside the path, one gives its table the name,
    and all read that one. A folder left without its mark of success is not taken for a table.
    """
    marker, files = _path(spark, f"{path.rstrip('/')}/_SUCCESS")
    if not files.exists(marker):
        target, _ = _path(spark, path)
        if files.exists(target):
            raise ValueError(f"{path} holds something that is no finished table")
        if not commit_table(build(), path) and not files.exists(marker):
            raise ValueError(f"{path} could not be written")
    return spark.read.parquet(path)


def write_series(df: DataFrame, path: str, month: str = "month", mode: str = "errorifexists") -> None:
    """A series in yearly folders, rows in the order of months, so that a time select opens only its years."""
    dated = df.withColumn("year", F.year(month))
    dated.repartition("year").sortWithinPartitions("year", month).write.mode(mode).option("compression", "zstd").partitionBy("year").parquet(path)


def scan_series(
    spark: SparkSession, path: str, schema: StructType | str, first: str | None = None, last: str | None = None, month: str = "month"
) -> DataFrame:
    """Months ``first`` to ``last`` of a series of :func:`write_series`. With its schema given no file is
    opened before the scan; folders of other years are not listed in it, and the months inside a year
    are picked by the statistics of its row groups."""
    given = f"{schema}, year int" if isinstance(schema, str) else StructType([*schema.fields, StructField("year", IntegerType())])
    df = spark.read.schema(given).parquet(path)
    for bound, below in ((first, False), (last, True)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            inside = (F.col("year") <= F.year(day)) & (F.col(month) <= day) if below else (F.col("year") >= F.year(day)) & (F.col(month) >= day)
            df = df.filter(inside)
    return _known(df.drop("year"))


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)
