"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(master: str | None = None, app: str = "gridcohort", **conf: str) -> SparkSession:
    """A session with the library defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """A subfolder of the session's own in the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. Only a local session without that setting
    gets a private one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if context.applicationId not in _private:
            _private[context.applicationId] = tempfile.mkdtemp(prefix="gridcohort-checkpoint-")
        named = _private[context.applicationId]
    return f"{named.rstrip('/')}/gridcohort-{context.applicationId}"


_private: dict[str, str] = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, as Parquet in the session's folder, and read it from there.

    For results that several jobs use. It survives lost executors, later jobs read only the
    columns they need, and its size is known to the optimizer. The tables stay until
    ``drop_intermediates`` or until the folder is removed.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def colocate(
    by: Sequence[str], *frames: DataFrame, sort: Sequence[Sequence[str]] = (), buckets: int | None = None, rows: int = 1_000_000
) -> list[DataFrame]:
    """The frames as intermediate tables in equal buckets of the columns ``by``, for work that is grouped by them.

    Joins, unions, groups and windows by these columns then take a bucket of every table as it
    lies, so tables that are used several times are shuffled once, here. Each bucket is one file,
    in the order of ``by`` and of the frame's own ``sort`` columns. ``buckets`` follows from the
    largest frame, about ``rows`` rows a bucket, if it isn't given. All rows of a key lie in one
    bucket: use it for keys with a bounded number of rows, such as the months of a cell. Null keys
    make a key of their own. Floating-point keys gain nothing: groups and joins normalise them first
    and move the rows again, so number such cells (``operators.cohort.dense_group_id``).
    """
    if buckets is None:
        buckets = max(1, math.ceil(max(f.count() for f in frames) / rows))
    out = []
    for i, frame in enumerate(frames):
        spark, name = frame.sparkSession, f"gridcohort_{uuid.uuid4().hex}"
        order = [*by, *(sort[i] if i < len(sort) else ())]
        dealt = frame.repartition(buckets, *by).write.format("parquet").bucketBy(buckets, *by).sortBy(*order)
        dealt.option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name)
        _bucketed.setdefault(spark.sparkContext.applicationId, []).append(name)
        out.append(spark.table(name))
    return out


_bucketed: dict[str, list[str]] = {}


def drop_intermediates(spark: SparkSession) -> None:
    """Remove the session's intermediate tables; results not yet computed from them are lost."""
    for name in _bucketed.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
