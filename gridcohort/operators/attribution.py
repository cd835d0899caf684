"""Coefficients projected back onto the grid: attributed events by cell and month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import keep_where_present, nearest_bucket, negative_part, positive_only, positive_part
from .grid import KEYS, rolling_mean
from .joins import skew_join

# Indicator ids of the population source and the years of the population grid.
POPULATION_ID, BIRTHS_ID = 49, 47
GRID_YEARS = (2000, 2005, 2010, 2015, 2020)


def pivot_indicators(rows: DataFrame, keys: Sequence[str], indicator: str, names: dict[int, str], value: str) -> DataFrame:
    """Indicator rows → one column per indicator."""
    wide = rows.groupBy(*keys).pivot(indicator, list(names)).agg(F.first(value, ignorenulls=True))
    return wide.withColumnsRenamed({str(k): v for k, v in names.items()})


def birth_ratio(
    rows: DataFrame,
    country: str = "LocationId",
    year: str = "Time",
    indicator: str = "IndicatorId",
    value: str = "Value",
    buckets: Sequence[int] = GRID_YEARS,
) -> DataFrame:
    """(country, year bucket, born_ratio): births over population, averaged over the years whose
    nearest bucket it is."""
    wide = pivot_indicators(rows, [country, year], indicator, {POPULATION_ID: "population", BIRTHS_ID: "births"}, value)
    placed = wide.withColumns(
        {"bucket": nearest_bucket(year, buckets), "ratio": F.try_divide("births", "population")}
    )
    return placed.groupBy(country, "bucket").agg(F.avg("ratio").alias("born_ratio"))


def country_values_on_grid(
    population: DataFrame, cells: DataFrame, ratio: DataFrame, country: str = "LocationId", year: str = "year"
) -> DataFrame:
    """Population cells (lat, lon, year, total_population) with the ratio of their country and year.

    Population counts at or below zero, and those of cells without a ratio, are null.
    """
    by_cell = cells.join(ratio.withColumnRenamed("bucket", year), country).select("lat", "lon", year, "born_ratio")
    merged = population.join(by_cell, ["lat", "lon", year], "left")
    counted = keep_where_present(positive_only("total_population"), "born_ratio")
    return merged.withColumn("total_population", counted)


def signed_means(
    grid: DataFrame, value: str, windows: Sequence[int] = (6, 9), keys: Sequence[str] = KEYS, month: str = "month"
) -> DataFrame:
    """``{value}_pos_{k}m`` / ``{value}_neg_{k}m`` of the trailing k-month means."""
    for k in windows:
        grid = rolling_mean(grid, value, k, f"_m{k}", keys, month)
    parts = {}
    for k in windows:
        parts[f"{value}_pos_{k}m"] = positive_part(f"_m{k}")
        parts[f"{value}_neg_{k}m"] = negative_part(f"_m{k}")
    return grid.withColumns(parts).drop(*[f"_m{k}" for k in windows])


# Terms whose coefficients add up to the effect of a life stage.
FIRST_YEAR = ("born_1m6m_b_avg", "born_6m12m_b_avg")
FROM_CONCEPTION = ("inutero_b_avg", *FIRST_YEAR)


def zone_effects(coefs: DataFrame, zone: str = "zone", key: str = "key", coef: str = "coef") -> DataFrame:
    """Sums of coefficients over outcomes and periods by zone, a missing coefficient as 0."""

    def total(stems: Sequence[str], side: str):
        wanted = [f"{s}_{side}_int" for s in stems]
        return F.sum(F.when(F.col(key).isin(wanted), F.coalesce(F.col(coef), F.lit(0.0))).otherwise(0.0))

    return coefs.groupBy(zone).agg(
        total(FROM_CONCEPTION, "pos").alias("high_iu"),
        total(FIRST_YEAR, "pos").alias("high_1y"),
        total(FROM_CONCEPTION, "neg").alias("low_iu"),
        total(FIRST_YEAR, "neg").alias("low_1y"),
    )


def attribute(
    grid: DataFrame,
    zones: DataFrame,
    effects: DataFrame,
    population: DataFrame,
    value: str = "stdm_t",
    keys: Sequence[str] = KEYS,
    month: str = "month",
    zone: str = "zone",
) -> DataFrame:
    """Attributed events per cell and month.

    ``grid`` has the signed 6- and 9-month means, ``zones`` one zone per cell, ``effects`` one row
    per zone, ``population`` (keys, month, total_population, born_ratio). Cells without a zone or an
    effect stay null. The negative part times its coefficient is the effect of low values.
    """
    keys = list(keys)
    by_cell = skew_join(zones, effects, [zone], "left")
    joined = grid.join(by_cell, keys, "left").join(population, [*keys, month], "left")
    pos = F.col(f"{value}_pos_9m") * F.col("high_iu") + F.col(f"{value}_pos_6m") * F.col("high_1y")
    neg = F.col(f"{value}_neg_9m") * F.col("low_iu") + F.col(f"{value}_neg_6m") * F.col("low_1y")
    sized = joined.withColumns({"n_childs": F.col("total_population") * F.col("born_ratio"), "_pos": pos, "_neg": neg})
    dead = sized.withColumns(
        {"pos_deaths": F.col("n_childs") * F.col("_pos") / 1000, "neg_deaths": F.col("n_childs") * F.col("_neg") / 1000}
    )
    rated = dead.withColumns(
        {
            "pos_deaths_per_1000": keep_where_present("_pos", "pos_deaths"),
            "neg_deaths_per_1000": keep_where_present("_neg", "neg_deaths"),
        }
    )
    return rated.withColumns(
        {
            "deaths_per_1000": F.col("pos_deaths_per_1000") + F.col("neg_deaths_per_1000"),
            "total_deaths": F.col("pos_deaths") + F.col("neg_deaths"),
        }
    ).drop("_pos", "_neg")
