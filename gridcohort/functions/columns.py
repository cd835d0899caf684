"""Column expressions: dates, snapping, signs, bins. All stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def clean_nans(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null instead of NaN, so that averages skip it and comparisons are not true by accident."""
    return df.withColumns({c: nan_to_null(c) for c in columns})


# --- coordinates and units -------------------------------------------------


def wrap_longitude(df: DataFrame, col: str = "lon") -> DataFrame:
    """0..360 degrees east to -180..180."""
    return df.withColumn(col, F.when(F.col(col) > 180, F.col(col) - 360).otherwise(F.col(col)))


def celsius(kelvin: Column | str) -> Column:
    return as_col(kelvin) - F.lit(273.15)


def whole_days(seconds: Column | str) -> Column:
    """A duration in seconds as whole days, cut towards zero."""
    return (as_col(seconds) / F.lit(86400.0)).cast("int")


def snap(c: Column | str, step: float, offset: float = 0.0) -> Column:
    """Nearest ``offset + n * step``; halves go to the even n."""
    return F.rint((as_col(c) - F.lit(offset)) / F.lit(step)) * F.lit(step) + F.lit(offset)


def southern(lat: Column | str) -> Column:
    return as_col(lat) < 0


# --- months ----------------------------------------------------------------


def month_start(c: Column | str) -> Column:
    return F.trunc(as_col(c).cast("date"), "month")


def month_index(date: Column | str) -> Column:
    """Months since year 0, so that month windows are plain integer ranges."""
    date = as_col(date)
    return F.year(date) * 12 + F.month(date) - 1


def index_month(index: Column | str) -> Column:
    index = as_col(index)
    year = F.floor(index / 12).cast("int")
    return F.make_date(year, (index - year * 12 + 1).cast("int"), F.lit(1))


def date_from_parts(year: Column | str, month: Column | str) -> Column:
    return F.make_date(as_col(year).cast("int"), as_col(month).cast("int"), F.lit(1))


def century_month_year(cmc: Column | str) -> Column:
    return (F.lit(1900) + F.floor((as_col(cmc) - 1) / 12)).cast("int")


def century_month_month(cmc: Column | str) -> Column:
    cmc = as_col(cmc)
    return (cmc - 12 * (century_month_year(cmc) - 1900)).cast("int")


# --- signs and powers ------------------------------------------------------


def sign_flags(c: Column | str) -> tuple[Column, Column]:
    """(>= 0, <= 0); both hold at 0 and neither for a missing value."""
    c = as_col(c)
    return F.coalesce(c >= 0, F.lit(False)), F.coalesce(c <= 0, F.lit(False))


def positive_part(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def negative_part(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(c, F.lit(0.0)))


def add_sign_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``_pos``/``_neg`` flags and ``_pos_int``/``_neg_int`` parts of every named column."""
    new = {}
    for name in columns:
        pos, neg = sign_flags(name)
        new |= {
            f"{name}_pos": pos,
            f"{name}_neg": neg,
            f"{name}_pos_int": positive_part(name),
            f"{name}_neg_int": negative_part(name),
        }
    return df.withColumns(new)


def add_powers(df: DataFrame, columns: Sequence[str], upto: int = 3) -> DataFrame:
    """``_squ`` and ``_cub`` columns."""
    suffix = {2: "_squ", 3: "_cub"}
    return df.withColumns(
        {
            f"{c}{suffix[p]}": reduce(lambda a, b: a * b, [F.col(c)] * p)
            for c in columns
            for p in range(2, upto + 1)
        }
    )


def positive_only(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c > 0, c)


def keep_where_present(c: Column | str, other: Column | str) -> Column:
    return F.when(as_col(other).isNotNull(), as_col(c))


# --- bins ------------------------------------------------------------------


def interval_bin(
    c: Column | str, edges: Sequence[float], labels: Sequence, right: bool = True, lowest: bool = False
) -> Column:
    """Label of the interval that holds the value, null outside.

    ``right`` closes intervals on the right, otherwise on the left; ``lowest`` also takes the
    first edge in. Infinite edges are open ends.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("one label per interval")
    c = as_col(c).cast("double")
    out = None
    for i, label in enumerate(labels):
        lo, hi = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        if right:
            inside = (c > lo) & (c <= hi)
            if lowest and i == 0:
                inside = (c >= lo) & (c <= hi)
        else:
            inside = (c >= lo) & (c < hi)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def one_hot_bins(
    c: Column | str, edges: Sequence[float], labels: Sequence[str], prefix: str, scale: int = 1000
) -> dict[str, Column]:
    """One column per left-closed interval: ``scale`` inside, 0 elsewhere and for null."""
    c = as_col(c).cast("double")
    return {
        f"{prefix}{label}": F.when((c >= float(edges[i])) & (c < float(edges[i + 1])), scale).otherwise(0)
        for i, label in enumerate(labels)
    }


# Day-count ranges, left-closed.
DAY_COUNT_BINS = ((1, 10), (10, 20), (20, 30))


def day_count_bins(name: str) -> dict[str, Column]:
    """Dummies of the day-count ranges [1,10), [10,20), [20,30); null stays null."""
    c = F.col(name)
    return {
        f"{name}_bin{hi}": F.when(c.isNull(), None).otherwise(((c >= lo) & (c < hi)).cast("int"))
        for lo, hi in DAY_COUNT_BINS
    }


def yes_flag(c: Column | str) -> Column:
    return F.coalesce(as_col(c) == "Yes", F.lit(False))


def threshold_flag(c: Column | str, threshold: float) -> Column:
    """1 at or above the threshold, 0 below, null for a missing value."""
    c = as_col(c)
    return F.when(c >= threshold, 1).when(c < threshold, 0)


def nearest_bucket(c: Column | str, buckets: Sequence[int]) -> Column:
    """The closest of a short fixed list; a tie goes to the smaller one."""
    c = as_col(c)
    ranked = [F.struct(F.abs(c - F.lit(b)).alias("gap"), F.lit(b).alias("bucket")) for b in sorted(buckets)]
    return F.least(*ranked)["bucket"] if len(ranked) > 1 else F.lit(buckets[0])


# --- strings ---------------------------------------------------------------


def natural_key(c: Column | str) -> Column:
    """A sort key under which digit runs compare as numbers and text without case."""
    pieces = F.regexp_extract_all(F.lower(as_col(c)), F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(x: Column) -> Column:
        digits = F.regexp_replace(x, r"^0+(?=\d)", "")
        padded = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        return F.when(x.rlike(r"^\d"), padded).otherwise(x)

    return F.transform(pieces, piece)


def number_text(c: Column | str) -> Column:
    """A printed number without stars, brackets and escapes; null where nothing is left."""
    kept = F.regexp_replace(as_col(c), r"[*()\\\s]", "")
    return kept.try_cast("double")


def stars(c: Column | str) -> Column:
    """Number of significance stars in a printed number."""
    return F.length(F.regexp_replace(as_col(c), r"[^*]", ""))


def narrowest_type(low: float, high: float, whole: bool) -> str:
    """Smallest Spark type that holds a value range."""
    if not whole:
        return "float" if max(abs(low), abs(high)) < 3.4028234e38 else "double"
    for name, bits in (("byte", 7), ("short", 15), ("int", 31)):
        if -(2**bits) <= low and high < 2**bits:
            return name
    return "long"
