from pyspark.sql import functions as F

from llm.common import is_scan, rows_of, store, with_row_ids


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(3).write.option("parquet.block.size", 64 << 10).parquet(path)
    docs = spark.read.parquet(path)
    assert len({r.rid for r in with_row_ids(spark.read.parquet(path, path), "doc_id").collect()}) == 40_000
    assert is_scan(docs) and not is_scan(docs.filter("doc_id > 3")) and not is_scan(docs.union(docs))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    ids = []
    try:
        for size in (before, "100k", "17k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            ids.append({r.doc_id: r.rid for r in with_row_ids(docs, "doc_id").collect()})
            if size == before:
                chosen = store(with_row_ids(docs, "doc_id").filter("doc_id % 1000 = 7").select("rid"), "chosen")
        kept = {r.doc_id for r in rows_of(docs, chosen).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0].values())) == 20_000
    assert kept == set(range(7, 20_000, 1000))


def test_ids_of_other_input(spark):
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, _file string").withColumn("_metadata", F.lit("x"))
    rows = with_row_ids(odd, *odd.columns, name="n").collect()
    assert len({r.n for r in rows}) == 3 and sorted(r._file or "" for r in rows) == ["", "a", "a"]
    assert with_row_ids(odd.filter("doc_id > 5"), "doc_id").count() == 0
