import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Documents with nulls, ties, repeated rows, white space, and columns whose names clash."""

    def make(*rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string")
        for name in ("rid", "ord", "kept", "score", "fp", "digest", "anchor", "n", "rule", "host"):
            df = df.withColumn(name, F.lit(None).cast("string"))
        return df

    return make
