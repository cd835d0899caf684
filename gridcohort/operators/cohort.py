"""Record cohorts: dates, windows, survivors, order within a mother, group numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import century_month_month, century_month_year, date_from_parts
from ..session import materialize
from .joins import skew_join

PRE_MONTHS = 9
POST_MONTHS = 35


def birth_cohort(
    births: DataFrame,
    window: tuple[str, str] = ("1991-01-01", "2021-01-01"),
    pre: int = PRE_MONTHS,
    post: int = POST_MONTHS,
    recency_days: int | None = 15 * 365,
    year: str = "chb_year",
    month: str = "chb_month",
    cmc: str = "v008",
) -> DataFrame:
    """Birth date, exposure window and interview columns; rows outside the study window, or not
    born 30..``recency_days`` days before the interview, leave. Both limits are strict."""
    dated = births.dropna(subset=[cmc, year, month]).withColumn("birth_date", date_from_parts(year, month))
    ranged = dated.withColumns(
        {"from_date": F.add_months("birth_date", -pre), "to_date": F.add_months("birth_date", post)}
    ).filter(
        (F.col("from_date") > F.lit(window[0]).cast("date")) & (F.col("to_date") < F.lit(window[1]).cast("date"))
    )
    asked = ranged.withColumns(
        {"interview_year": century_month_year(cmc), "interview_month": century_month_month(cmc)}
    ).withColumn("interview_date", date_from_parts("interview_year", "interview_month"))
    days = F.datediff("interview_date", "birth_date")
    flagged = asked.withColumns(
        {
            "days_from_interview": days,
            "last_15_years": (days > 30) & (days < 15 * 365),
            "last_10_years": (days > 30) & (days < 10 * 365),
            "since_2003": F.col("interview_year") >= 2003,
        }
    )
    if recency_days is None:
        return flagged
    return flagged.filter((F.col("days_from_interview") > 30) & (F.col("days_from_interview") < recency_days))


def distinct_points(births: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each (cell, start month) once: exposure is the same for all records that share it."""
    return births.dropna(subset=list(keys)).select(*keys).distinct()


def survivors(df: DataFrame, age: str, min_age: int) -> DataFrame:
    """Rows alive (null age at death) or dead at ``min_age`` or later."""
    return df.filter(F.col(age).isNull() | (F.col(age) >= min_age))


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], tie: str, out: str) -> DataFrame:
    """1-based position of each row among the rows of its key, by ``order`` and then ``tie``.

    ``tie`` is unique. Rows are range-partitioned by (key, order, tie), so one key may own most of
    the table and still spread over many tasks. A row's position is its position in its partition
    plus the rows of its key in the partitions before, of which there is one number per key and
    partition. The partitioned table is written once: counts and rows need the same layout.
    """
    name = [*keys, *order, tie]
    ordered = df.repartitionByRange(*name).sortWithinPartitions(*name)
    placed = materialize(ordered.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order, tie)
    upto = Window.partitionBy(*keys).orderBy("_part")
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    shift = sizes.select(*keys, "_part", (F.sum("_n").over(upto) - F.col("_n")).alias("_shift"))
    on = F.col("a._part") == F.col("b._part")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    numbered = placed.withColumn("_place", F.row_number().over(inside)).alias("a").join(shift.alias("b"), on)
    return numbered.select(*[f"a.{c}" for c in df.columns], (F.col("a._place") + F.col("b._shift")).alias(out))


def birth_order(df: DataFrame, mother: str, month: str, tie: str, out: str = "birth_order") -> DataFrame:
    return rank_within(df, [mother], [month], tie, out)


def _numbered(ordered: DataFrame, columns: Sequence[str], out: str, start: int) -> DataFrame:
    """Rows of a sorted frame with consecutive numbers: the place in the partition plus the rows of
    the partitions before. The frame is written once, because counts and rows need one layout."""
    placed = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition: this window is as small as the job is wide.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = placed.withColumn("_part", part).join(F.broadcast(shift), "_part")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.select(*columns, (F.col("_shift") + inside + start).cast("long").alias(out))


def number_keys(df: DataFrame, keys: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """The distinct keys in ascending order with consecutive numbers from ``start``."""
    return _numbered(df.select(*keys).distinct().orderBy(*keys), keys, out, start)


def dense_group_id(df: DataFrame, keys: Sequence[str], out: str, start: int = 0) -> DataFrame:
    """Every row with the number of its key combination."""
    return skew_join(df, number_keys(df, keys, out, start), keys)


def row_ids(df: DataFrame, order: Sequence[str], out: str = "ID") -> DataFrame:
    """Consecutive numbers from 0 over rows that are unique by ``order``."""
    return _numbered(df.orderBy(*order), df.columns, out, 0)
