"""Feature columns and their names."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import narrowest_type, one_hot_bins
from .joins import skew_join

INFINITY = float("inf")

# Age-at-event bins (months, left-closed) by scheme.
AGE_BINS = {
    "quarterly": ([0, 3, 6, 9, 12, 15, INFINITY], ["1m3m", "3m6m", "6m9m", "9m12m", "12m15m", "alive"]),
    "biannual": (
        [0, 6, 12, 18, 24, 30, 36, INFINITY],
        ["1m6m", "6m12m", "12m18m", "18m24m", "24m30m", "30m36m", "alive"],
    ),
    "inutero": ([0, 1, 3, 7, INFINITY], ["1m", "2m3m", "3m7m", "alive"]),
    "months": ([0, 1, 2, 3, 4, 5, 6, INFINITY], ["1m", "2m", "3m", "4m", "5m", "6m", "alive"]),
}
ALIVE = 1000

# Schooling bins (right-closed) and their labels.
EDUCATION_EDGES = [0, 7, 13, 35, INFINITY]
EDUCATION_LABELS = ["6 years or less", "6-12 years", "more than 12 years", "No data"]

# Climate class codes 1..31 in order, and the two coarser label levels.
CLASS_LEVEL_3 = (
    "Af", "Am", "As", "Aw", "BSh", "BSk", "BWh", "BWk", "Cfa", "Cfb",
    "Cfc", "Csa", "Csb", "Csc", "Cwa", "Cwb", "Cwc", "Dfa", "Dfb", "Dfc",
    "Dfd", "Dsa", "Dsb", "Dsc", "Dsd", "Dwa", "Dwb", "Dwc", "Dwd", "EF",
    "ET",
)
CLASS_LEVEL_2 = {
    "Af": "Tropical (Rainforest)",
    "Am": "Tropical (Monsoon)",
    "As": "Tropical (Savanna, dry winter)",
    "Aw": "Tropical (Savanna, dry summer)",
    "BS": "Arid desert",
    "BW": "Semi-Arid steppe",
    "Cf": "Temperate (No dry season)",
    "Cs": "Temperate (Dry summer)",
    "Cw": "Temperate (Dry winter)",
    "Df": "Continental (No dry season)",
    "Ds": "Continental (Dry summer)",
    "Dw": "Continental (Dry winter)",
    "EF": "Polar (Tundra)",
    "ET": "Polar (Ice cap)",
}
CLASS_LEVEL_1 = {"A": "Tropical", "B": "Arid", "C": "Temperate", "D": "Continental", "E": "Polar"}


def class_labels(spark) -> DataFrame:
    """(code, label_3, label_2, label_1) of the 31 land classes."""
    rows = [
        (i, name, CLASS_LEVEL_2[name[:2]], CLASS_LEVEL_1[name[:1]]) for i, name in enumerate(CLASS_LEVEL_3, start=1)
    ]
    return spark.createDataFrame(rows, "code int, label_3 string, label_2 string, label_1 string")


def age_dummies(df: DataFrame, age: str, schemes: Sequence[str] = tuple(AGE_BINS)) -> DataFrame:
    """``{age}_{scheme}_{label}``: 1000 in the bin, 0 outside. A missing age counts as alive."""
    filled = F.coalesce(F.col(age), F.lit(ALIVE))
    new = {}
    for scheme in schemes:
        edges, labels = AGE_BINS[scheme]
        new |= one_hot_bins(filled, edges, labels, f"{age}_{scheme}_")
    return df.withColumns(new)


def narrow_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast each numeric column to the smallest type that holds its range; one pass finds the ranges."""
    types = dict(df.dtypes)
    row = df.agg(
        *[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    casts = {}
    for i, c in enumerate(columns):
        if row[f"lo{i}"] is not None:
            whole = types[c] in ("tinyint", "smallint", "int", "bigint")
            casts[c] = F.col(c).cast(narrowest_type(row[f"lo{i}"], row[f"hi{i}"], whole))
    return df.withColumns(casts)


# --- names as metadata -----------------------------------------------------

_NAME = re.compile(
    r"(?P<var>.+?)_(?P<period>(?:inutero|born)(?:_[0-9a-z]+)?)_(?P<scheme>q|b|m|iu)_(?P<stat>avg|max|min|w\d+)"
    r"(?P<square>_sq)?(?:_(?P<part>pos|neg|q[1-4]|bin\d+))?(?P<product>_int)?"
)


@dataclass(frozen=True)
class FeatureName:
    var: str
    period: str
    scheme: str
    stat: str
    square: bool = False
    part: str | None = None
    product: bool = False


def parse_feature(name: str) -> FeatureName | None:
    m = _NAME.fullmatch(name)
    if not m:
        return None
    return FeatureName(
        m["var"], m["period"], m["scheme"], m["stat"], bool(m["square"]), m["part"], bool(m["product"])
    )


def catalog(df: DataFrame) -> dict[str, FeatureName]:
    """Parsed name of every exposure column of a frame."""
    parsed = {c: parse_feature(c) for c in df.columns}
    return {c: p for c, p in parsed.items() if p}


def select_features(
    df: DataFrame,
    variables: Sequence[str],
    scheme: str | None = None,
    stat: str | None = None,
    plus: Sequence[str] = (),
) -> DataFrame:
    """Exposure columns by variable, scheme and statistic, then the columns named in ``plus``."""
    chosen = [
        c
        for c, p in catalog(df).items()
        if p.var in variables and scheme in (None, p.scheme) and stat in (None, p.stat)
    ]
    return df.select(*dict.fromkeys([*plus, *chosen]))


def add_group_share(df: DataFrame, by: Sequence[str], columns: Sequence[str], total: str) -> DataFrame:
    """Group totals on every row (``set_*``) and their share of the group total of ``total``."""
    sums = df.groupBy(*by).agg(*[F.sum(c).alias(f"set_{c}") for c in dict.fromkeys([*columns, total])])
    joined = skew_join(df, sums, list(by))
    return joined.withColumns({f"set_{c}_share": F.try_divide(f"set_{c}", f"set_{total}") for c in columns})
