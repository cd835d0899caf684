"""Registered queries: a Spark function, its output columns and, where SQL can say it, the same in SQL.

The column list fixes names and types on both sides: ``i`` whole number, ``f`` double rounded to
4 places (``f6``: 6), ``s`` text, ``b`` boolean, ``d`` date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": "bigint", "f": "double", "s": "string", "b": "boolean", "d": "date"}
_SQL = {"i": "BIGINT", "f": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN", "d": "DATE"}


def _columns(text: str) -> list[tuple[str, str, int]]:
    out = []
    for item in text.split():
        name, kind = item.rsplit(":", 1)
        out.append((name, kind[0], int(kind[1:] or 4)))
    return out


def _shift(digits: int) -> float:
    """Moves values off the rounding limit: means of prices often end in an exact 5 there, and the
    two engines add in different order."""
    return 0.037 * 10**-digits


def query(columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name. ``sql`` ends in a SELECT with the same columns."""
    listed = _columns(columns)

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            out = []
            for name, kind, digits in listed:
                c = F.col(name).cast(_SPARK[kind])
                out.append((F.round(c + F.lit(_shift(digits)), digits) + F.lit(0.0) if kind == "f" else c).alias(name))
            return df.select(*out)

        QUERIES[fn.__name__] = run
        if sql:
            shown = []
            for name, kind, digits in listed:
                c = f'CAST("{name}" AS {_SQL[kind]})'
                shown.append((f"round({c} + CAST({_shift(digits)} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)" if kind == "f" else c) + f' AS "{name}"')
            ORACLES[fn.__name__] = f"SELECT {', '.join(shown)} FROM (\n{sql.strip()}\n) AS answer"
        return fn

    return register
