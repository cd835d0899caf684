"""Gridded monthly series: one row per cell and month.

Windows here are partitioned by the cell. A cell has one row per month, so such a group is as
long as the record in months, however many cells there are. ``cell_months`` builds such a table
from raw rows with partial sums first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import month_index

KEYS = ("lat", "lon")


def cell_months(df: DataFrame, keys: Sequence[str], month: str, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys, month).agg(*[a.alias(n) for n, a in aggs.items()])


def select_months(df: DataFrame, first: str, last: str, month: str = "month") -> DataFrame:
    """Both ends included."""
    return df.filter(F.col(month).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def select_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return df.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def climatology(
    grid: DataFrame, value: str, keys: Sequence[str] = KEYS, by_month: bool = False, month: str = "month"
) -> DataFrame:
    """Mean and population standard deviation per cell, or per cell and calendar month."""
    by = list(keys)
    if by_month:
        grid = grid.withColumn("moy", F.month(month))
        by.append("moy")
    return grid.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("n"))


def standardized_anomaly(
    grid: DataFrame,
    value: str,
    out: str,
    keys: Sequence[str] = KEYS,
    by_month: bool = True,
    scale: bool = True,
    baseline: tuple[int, int] | None = None,
    month: str = "month",
) -> DataFrame:
    """Deviation from the cell's mean, per calendar month or overall, divided by its population
    standard deviation when ``scale``. ``baseline`` limits the reference to years y0..y1."""
    part = [F.col(k) for k in keys] + ([F.month(month)] if by_month else [])
    over = Window.partitionBy(*part)
    base = F.col(value)
    if baseline:
        base = F.when(F.year(month).between(*baseline), base)
    gap = F.col(value) - F.avg(base).over(over)
    if not scale:
        return grid.withColumn(out, gap)
    sd = F.stddev_pop(base).over(over)
    return grid.withColumn(out, F.when(sd > 0, gap / sd))


def anomalies(
    grid: DataFrame,
    value: str,
    keys: Sequence[str] = KEYS,
    baseline: tuple[int, int] | None = None,
    month: str = "month",
    names: tuple[str, str, str, str] = ("std_t", "absdif_t", "stdm_t", "absdifm_t"),
) -> DataFrame:
    """All four anomaly variants; the windows share one exchange on the cell."""
    variants = zip(names, [(False, True), (False, False), (True, True), (True, False)])
    return reduce(
        lambda g, v: standardized_anomaly(g, value, v[0], keys, v[1][0], v[1][1], baseline, month), variants, grid
    )


def _months_frame(keys: Sequence[str], month: str, first: int, last: int):
    """Frame in calendar months, so a gap in the series stays a gap."""
    return Window.partitionBy(*keys).orderBy(month_index(F.col(month))).rangeBetween(first, last)


def rolling_sum(
    grid: DataFrame, value: str, k: int, out: str, keys: Sequence[str] = KEYS, month: str = "month"
) -> DataFrame:
    """Sum of the last k months, null until k values are there."""
    over = _months_frame(keys, month, -(k - 1), 0)
    return grid.withColumn(out, F.when(F.count(value).over(over) == k, F.sum(value).over(over)))


def rolling_mean(
    grid: DataFrame,
    value: str,
    k: int,
    out: str,
    keys: Sequence[str] = KEYS,
    month: str = "month",
    centered: bool = False,
) -> DataFrame:
    """Mean of k months, trailing or centred, null unless all k values are there."""
    first = -(k // 2) if centered else -(k - 1)
    over = _months_frame(keys, month, first, first + k - 1)
    return grid.withColumn(out, F.when(F.count(value).over(over) == k, F.avg(value).over(over)))


def coordinate_merge(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Outer alignment of many variables on the coordinates, in one shuffle.

    Each frame holds its own columns and is unique by the keys; a column found in several
    frames takes the largest value.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def land_mask(grid: DataFrame, mask: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Null the value in cells where the mask has no value. ``mask`` is (keys, land), unique."""
    joined = grid.join(mask.select(*keys, F.col("land").alias("_land")), list(keys), "left")
    return joined.withColumn(value, F.when(F.col("_land").isNotNull(), F.col(value))).drop("_land")


def exceedance_share(
    grid: DataFrame,
    value: str,
    threshold: float,
    out: str,
    side: str = "above",
    denominator: float | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Share of months above ``threshold`` or below ``-threshold``, over a fixed number of months
    or over the months present."""
    hit = F.col(value) > threshold if side == "above" else F.col(value) < -threshold
    whole = F.lit(float(denominator)) if denominator else F.count("*")
    return grid.groupBy(*keys).agg((F.count_if(hit) / whole).alias(out))


def cell_means(grid: DataFrame, values: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return grid.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def month_totals(grid: DataFrame, values: Sequence[str], month: str = "month") -> DataFrame:
    return grid.groupBy(month).agg(*[F.sum(v).alias(v) for v in values])


def gap_fill_linear(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    first: str,
    last: str,
    month: str = "month",
) -> DataFrame:
    """Values at scattered months → every month of [first, last], linear in days between
    neighbours and extrapolated from the two outermost known values. A single known value is held constant."""
    keys = list(keys)
    kind = dict(df.dtypes)[month]
    start, stop = (F.lit(d).cast("date") for d in (first, last))
    known = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(month).alias("t"), F.col(value).cast("double").alias("v"))
        .groupBy(*keys, "t")
        .agg(F.max("v").alias("v"))
    )
    order = Window.partitionBy(*keys).orderBy("t")
    point = F.struct("t", "v")
    # Only known points are shuffled and sorted: each makes the months from it to the next one, the
    # first also those before it.
    placed = known.select(*keys, point.alias("at"), F.lag(point).over(order).alias("p"), F.lead(point).over(order).alias("n"))
    months = F.sequence(start, stop, F.expr("interval 1 month"))
    own = F.filter(
        F.transform(months, lambda m: m.cast(kind)),
        lambda m: (F.col("p").isNull() | (m >= F.col("at.t"))) & (F.col("n").isNull() | (m < F.col("n.t"))),
    )
    wanted = placed.withColumn("t", F.explode(own))

    def line(a: str, b: str) -> Column:
        slope = (F.col(f"{b}.v") - F.col(f"{a}.v")) / F.datediff(f"{b}.t", f"{a}.t")
        return F.col(f"{a}.v") + slope * F.datediff("t", f"{a}.t")

    filled = (
        F.when(F.col("t") == F.col("at.t"), F.col("at.v"))
        .when(F.col("t") < F.col("at.t"), F.coalesce(line("at", "n"), F.col("at.v")))
        .when(F.col("n").isNull(), F.coalesce(line("p", "at"), F.col("at.v")))
        .otherwise(line("at", "n"))
    )
    return wanted.select(*keys, F.col("t").alias(month), filled.alias(value))


def regrid(
    src: DataFrame,
    targets: DataFrame,
    values: Sequence[str],
    src_step: float,
    src_offset: float = 0.0,
    by: Sequence[str] = ("month",),
    method: str = "linear",
) -> DataFrame:
    """Values of a regular source grid at target cells.

    ``linear`` weighs the surrounding nodes (2 per axis, 1 where the target sits on a node) and is
    null where one of them is missing; ``nearest`` takes the closest node. Target cells carry
    (lat, lon), source rows (lat, lon, *by). Nodes meet by whole-number index, never by a
    floating-point key.
    """
    by = list(by)

    def place(c: str) -> Column:
        return (F.col(c) - F.lit(src_offset)) / F.lit(src_step)

    nodes = src.select(
        F.rint(place("lat")).cast("long").alias("i"), F.rint(place("lon")).cast("long").alias("j"), *by, *values
    )
    cells = targets.select("lat", "lon").distinct()
    if method == "nearest":
        near = cells.withColumns({"i": F.rint(place("lat")).cast("long"), "j": F.rint(place("lon")).cast("long")})
        return near.join(nodes, ["i", "j"]).select("lat", "lon", *by, *values)
    if method != "linear":
        raise ValueError(f"unknown method {method}")

    def corners(c: str) -> Column:
        # a target within 1e-9 of a node sits on it
        node = F.rint(place(c))
        at = F.when(F.abs(place(c) - node) < 1e-9, node).otherwise(place(c))
        low = F.floor(at).cast("long")
        share = at - low
        return F.filter(
            F.array(
                F.struct(low.alias("k"), (1 - share).alias("w")), F.struct((low + 1).alias("k"), share.alias("w"))
            ),
            lambda s: s["w"] > 0,
        )

    weighted = (
        cells.withColumns({"a": corners("lat"), "b": corners("lon")})
        .withColumn("need", F.size("a") * F.size("b"))
        .withColumn("a", F.explode("a"))
        .withColumn("b", F.explode("b"))
        .select("lat", "lon", "need", F.col("a.k").alias("i"), F.col("b.k").alias("j"), (F.col("a.w") * F.col("b.w")).alias("w"))
    )
    mixed = weighted.join(nodes, ["i", "j"])
    return (
        mixed.groupBy("lat", "lon", *by)
        .agg(
            *[
                F.when(F.count(v) == F.max("need"), F.sum(F.col(v) * F.col("w"))).alias(v)
                for v in values
            ]
        )
    )
