"""Helpers of the operators: shared folder, stored tables, row identities, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder name under spark.checkpoint.dir; a private one only in local mode with none set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="llm-"))
        base = _own[0]
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as Parquet in the shared folder and read it from there.

    Its shuffle files go when it is written: the table replaces them, also when executors are lost.
    """
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Remove all stored intermediate results of the shared folder; what is not yet computed from them is lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(workspace(spark, "x").rpartition("/")[0])
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_scan(df: DataFrame) -> bool:
    """Whether the rows of `df` are those of the Parquet files below one path, once each, so that file and
    place name a row: its plan is that relation and nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    relation = plan.relation()
    return relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and relation.location().rootPaths().size() == 1


#: Bits for a row's place in its file; files of a table, of which every task gets 16 bytes each.
FILE_ROWS, FILES = 40, 1 << 22


def with_row_ids(df: DataFrame, *cols: str | Column, name: str = "rid") -> DataFrame:
    """Chosen columns and `name`, a number of the row that is the same at each evaluation.

    It is made of the number of the row's file, in the order of the paths, and the row's place in the
    file, so it does not depend on how a scan is split. The files' numbers are a stored table of
    path hashes, which goes to the tasks: 64 MB at most, as a table with more files than FILES is
    written anew with fewer. Input that is not read from Parquet files as it is gets stored first.
    """
    if not is_scan(df):
        df = store(df, "numbered")
    at = df.metadataColumn("_metadata")
    paths = df.select(at["file_path"].alias("path")).distinct()
    hashed = paths.select(F.xxhash64("path").alias("file"), (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("number"))
    files = store(hashed, "files")
    count, kinds = files.agg(F.count("*"), F.count_distinct("file")).first()
    if count > FILES or kinds < count:  # or two paths with one hash: the new files have other names
        return with_row_ids(store(df.coalesce(FILES // 2), "numbered"), *cols, name=name)
    given = df.select(*cols).columns
    file, number = (_unused(n, [*given, name]) for n in ("_file", "_file_number"))
    rows = df.select(*cols, at["row_index"].alias(name), F.xxhash64(at["file_path"]).alias(file))
    joined = rows.join(F.broadcast(files.toDF(file, number)), file)
    return joined.withColumn(name, F.shiftleft(F.col(number), FILE_ROWS).bitwiseOR(F.col(name))).drop(file, number)


def _unused(name: str, columns: list[str]) -> str:
    while name in columns:
        name += "_"
    return name


def arrow_map(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Arrow batches through fn: a dict of column lists to a dict of column lists, arrays or Arrow arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, batch.num_rows, ROWS):
                out = fn(batch.slice(step, ROWS).to_pydict())
                if out:
                    yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


ROWS = 1000


def id_order(doc_id: str = "doc_id") -> Column:
    """A sort key for 'the smallest doc_id': nulls come last."""
    return F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"))


def rows_of(df: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of `df`, all columns, whose row ids (`with_row_ids`) are in the column `rid`."""
    name = _unused("_row_id", df.columns)
    return with_row_ids(df, *(F.col(f"`{c}`") for c in df.columns), name=name).join(rids.select(F.col("rid").alias(name)), name, "left_semi").drop(name)
