"""Exact deduplication as a stream with disk-backed keyed state.

The documents are read as a file stream. Its state, kept in RocksDB and without expiry, has one
entry per digest of a normalised text: the smallest document id, the locator (file, row) of that
row's content, and the number of rows. Rows of equal digest are combined before they are shuffled,
so a text that fills a third of the table costs one row per task. A later run with the same
checkpoint goes on with the state and reads only new files.

A hit is only a candidate: its whole text is compared with the text at the locator. Digests under
which texts differ are resolved by grouping those texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from llm.common import store, workspace

#: RocksDB, without the 4 MB that it sets aside on disk for each partition's manifest.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Hits that are compared with one copy of the kept text.
HITS_PER_COPY = 256
#: Bytes of files in one micro-batch.
BATCH_BYTES = 64 << 30


def normalised(text: str = "text") -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _first(doc_id: str = "doc_id") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), F.col("_at.file").alias("file"), F.col("_at.row").alias("row"))


def update_state(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES, schema: StructType | None = None) -> DataFrame:
    """Run the stream over all files at `path` that the checkpoint has not seen; return the state.

    Columns: digest, first (missing, id, file, row), n.
    """
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a stream of a single file needs its path as a pattern
        path = path.rstrip("/")
        stream = (
            spark.readStream.schema(schema or spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
            .select("doc_id", _locator().alias("_at"), digest(normalised()).alias("digest"))
            .groupBy("digest").agg(F.min(_first()).alias("first"), F.count("*").alias("n"))
        )
        query = stream.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    state = spark.read.format("statestore").load(checkpoint)
    least, count = (f.name for f in state.schema["value"].dataType.fields)
    return state.select("key.digest", F.col(f"value.{least}").alias("first"), F.col(f"value.{count}").alias("n"))


def exact_dedup(spark: SparkSession, docs: DataFrame | str, digest: Callable[[Column], Column] = sha256, checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """All columns of `docs` and keep_id, group_size, kept, text_sha256, for every row.

    `docs` is a path of Parquet files, streamed in place, or a DataFrame, which is stored first.
    Of rows with equal normalised text the one with the smallest doc_id stays; equal ids: the first
    by file and position; null ids come last. Null and empty texts are one group. Repeated rows are
    copies like any others. Columns of `docs` with the names of the results are replaced.
    """
    if isinstance(docs, DataFrame):
        schema, path = docs.schema, workspace(spark, "docs")
        docs.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    else:
        path, docs = docs, spark.read.parquet(docs)
    named = [F.col(f"`{c}`") for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    state = store(update_state(spark, path, checkpoint or workspace(spark, "state"), digest, batch_bytes, docs.schema), "classes")
    rows = docs.select(F.struct(*named).alias("_row"), _locator().alias("_at"), normalised().alias("_norm")).withColumn("digest", digest(F.col("_norm")))
    at_first = (F.col("_at.file") == F.col("first.file")) & (F.col("_at.row") == F.col("first.row"))
    joined = rows.join(state, "digest")

    # every hit against the whole text at the locator
    hits = store(joined.filter(F.col("n") > 1).select("digest", "_at", "_norm", "n", at_first.alias("_kept")), "hits")
    parts = F.ceil(F.col("n") / HITS_PER_COPY).cast("int")
    copies = hits.filter("not _kept").withColumn("part", F.pmod(F.xxhash64("_at.file", "_at.row"), parts).cast("int"))
    kept = hits.filter("_kept").select("digest", F.col("_norm").alias("_first"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    wrong = store(copies.join(kept, ["digest", "part"]).filter(F.col("_norm") != F.col("_first")).select("digest").distinct(), "collisions")
    shown = ["_row.*", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), at_first.alias("kept"), F.sha2("_norm", 256).alias("text_sha256")]
    if wrong.isEmpty():
        return joined.select(*shown)
    mixed = rows.join(wrong, "digest", "left_semi")
    by_text = mixed.groupBy("_norm").agg(F.min(_first("_row.doc_id")).alias("first"), F.count("*").alias("n"))
    return joined.join(wrong, "digest", "left_anti").select(*shown).unionByName(mixed.join(by_text, "_norm").select(*shown))

