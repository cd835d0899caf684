"""Exposure windows: grid values of a cell over the months before and after a start month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import month_index
from .joins import skew_join

# Last month offset of each period, by scheme. Offset 0 is nine months before birth.
# A period starts one month after the previous one ends.
SCHEMES = {
    "q": {
        "inutero_1m3m": 2,
        "inutero_3m6m": 5,
        "inutero_6m9m": 8,
        "born_1m3m": 11,
        "born_3m6m": 14,
        "born_6m9m": 17,
        "born_9m12m": 20,
    },
    "b": {
        "inutero": 8,
        "born_1m": 9,
        "born_1m6m": 14,
        "born_6m12m": 20,
        "born_12m18m": 26,
        "born_18m24m": 32,
        "born_24m30m": 38,
        "born_30m36m": 44,
    },
    "iu": {
        "inutero_1m3m": 2,
        "inutero_3m6m": 5,
        "inutero_6m9m": 8,
        "born_1m": 9,
        "born_2m3m": 11,
        "born_3m6m": 14,
    },
    "m": {
        **{f"inutero_{i}m": i - 1 for i in range(1, 10)},
        **{f"born_{i}m": i + 8 for i in range(1, 7)},
    },
}
STATS = {"q": ["avg"], "b": ["avg", *[f"w{k}" for k in range(1, 10)]], "iu": ["avg"], "m": ["avg"]}
VARIABLES = ("spi1", "stdm_t", "absdifm_t", "hd35", "hd40", "fd", "id")
WINDOW_MONTHS = 45


@dataclass(frozen=True)
class Period:
    scheme: str
    period: str
    stat: str  # avg, max, min over the period, or wK: mean of the K months that end with it
    start: int
    end: int

    @property
    def first(self) -> int:
        return self.end - int(self.stat[1:]) + 1 if self.stat[0] == "w" else self.start

    def name(self, value: str) -> str:
        return f"{value}_{self.period}_{self.scheme}_{self.stat}"


def period_table(
    schemes: dict[str, dict[str, int]] = SCHEMES,
    stats: dict[str, Sequence[str]] = STATS,
    months: int = WINDOW_MONTHS,
) -> list[Period]:
    out = []
    for scheme, ends in schemes.items():
        start = 0
        for period, end in ends.items():
            for stat in stats[scheme]:
                p = Period(scheme, period, stat, start, end)
                if not 0 <= p.first <= end < months:
                    raise ValueError(f"{p} leaves the window of {months} months")
                out.append(p)
            start = end + 1
    return out


@dataclass(frozen=True)
class _Span:
    """Months that some periods share: one aggregation group serves all of them."""

    start: int
    end: int
    width: int
    moves: bool  # a wK window, which follows the event


def _spans(periods: Sequence[Period], until_event: bool) -> dict[_Span, list[Period]]:
    out: dict[_Span, list[Period]] = {}
    for p in periods:
        moves = until_event and p.stat[0] == "w"
        start = p.start if until_event else p.first
        out.setdefault(_Span(start, p.end, p.end - p.first + 1, moves), []).append(p)
    return out


def period_offsets(spark: SparkSession, periods: Sequence[Period], until_event: bool = False) -> DataFrame:
    """(span, start, end, width, moves, offset): the months of each distinct span of the periods.

    A few hundred rows, fixed by the schemes. With an event every month that a span can reach.
    """
    rows = []
    for i, s in enumerate(_spans(periods, until_event)):
        first = max(s.start - s.width + 1, 0) if s.moves else s.start
        rows += [(i, s.start, s.end, s.width, s.moves, o) for o in range(first, s.end + 1)]
    return spark.createDataFrame(rows, "span int, start int, end int, width int, moves boolean, offset int")


def exposure_window(
    points: DataFrame,
    grid: DataFrame,
    values: Sequence[str],
    cell: Sequence[str] = ("lat", "lon"),
    months: int = WINDOW_MONTHS,
    start: str = "from_date",
    month: str = "month",
) -> DataFrame:
    """The months start..start+months-1 of each point's cell, one row per month with an offset.

    An equi-join on (cell, month): the range is spelled out as offsets on the point side.
    """
    spelled = points.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).withColumn(
        month, F.add_months(F.col(start), F.col("offset"))
    )
    return spelled.join(grid.select(*cell, month, *values), [*cell, month]).drop(month)


_AGGREGATES = {"avg": F.avg, "max": F.max, "min": F.min}


def _aggregate(stat: str) -> str:
    return stat if stat in _AGGREGATES else "avg"


def period_exposure(
    points: DataFrame,
    grid: DataFrame,
    values: Sequence[str],
    periods: Sequence[Period],
    cell: Sequence[str] = ("lat", "lon"),
    keys: Sequence[str] | None = None,
    event_offset: str | None = None,
    start: str = "from_date",
    month: str = "month",
) -> DataFrame:
    """Long exposures (keys, var, scheme, period, stat, value) of unique points.

    Every month joins the spans that hold its offset (a broadcast of the fixed period table), all
    values and statistics of a span are aggregated together, and only the results are spelled out
    per variable and period. ``event_offset`` names a point column: a period that starts after it
    is null, one that holds it ends there, and a wK window moves to end there.
    """
    keys = list(keys or [*cell, start] + ([event_offset] if event_offset else []))
    spark = points.sparkSession
    spans = _spans(periods, bool(event_offset))
    months = exposure_window(points.select(*keys).distinct(), grid, values, cell, start=start, month=month)
    matched = months.join(F.broadcast(period_offsets(spark, periods, bool(event_offset))), "offset")
    used = {v: F.col(v) for v in values}
    if event_offset:
        stop = F.least("end", F.coalesce(F.col(event_offset), F.col("end")))
        first = F.when(F.col("moves"), stop - F.col("width") + 1).otherwise(F.col("start"))
        inside = (stop >= F.col("start")) & F.col("offset").between(first, stop)
        used = {v: F.when(inside, F.col(v)) for v in values}
    kinds = sorted({_aggregate(p.stat) for p in periods})
    totals = matched.groupBy(*keys, "span").agg(
        *[_AGGREGATES[k](used[v]).alias(f"_{k}{i}") for i, v in enumerate(values) for k in kinds]
    )
    served = spark.createDataFrame(
        [(i, p.scheme, p.period, p.stat, _aggregate(p.stat)) for i, ps in enumerate(spans.values()) for p in ps],
        "span int, scheme string, period string, stat string, kind string",
    )
    chosen = [F.coalesce(*[F.when(F.col("kind") == k, F.col(f"_{k}{i}")) for k in kinds]) for i in range(len(values))]
    pairs = F.array(*[F.struct(F.lit(v).alias("var"), c.alias("value")) for v, c in zip(values, chosen)])
    return (
        totals.join(F.broadcast(served), "span")
        .select(*keys, "scheme", "period", "stat", F.explode(pairs).alias("_p"))
        .select(*keys, "_p.var", "scheme", "period", "stat", "_p.value")
    )


def exposure_features(
    points: DataFrame,
    grid: DataFrame,
    values: Sequence[str] = VARIABLES,
    periods: Sequence[Period] | None = None,
    cell: Sequence[str] = ("lat", "lon"),
    start: str = "from_date",
    month: str = "month",
) -> DataFrame:
    """Wide exposures, one row per unique point and one column per (value, period).

    Points and grid months of a cell are laid on one time line and each period is a frame of
    months ahead of the start, so nothing is repeated per offset: the grid is shuffled by cell,
    and only cells that hold a point take part. Tables of ``session.colocate`` by cell aren't
    shuffled at all. A missing month is left out of the mean.
    A point without any grid month in its window has no row, as in the long form.
    """
    periods = list(periods or period_table())
    starts = points.select(*cell, start).distinct()
    # A union keeps the partitioning of its parts only if their keys are as nullable as the scanned
    # columns; a join's keys aren't, but their new names are.
    named = {c: f"_cell_{c}" for c in cell}
    asked = starts.select(*cell, F.col(start).alias(month)).withColumnsRenamed(named).withColumn("_asked", F.lit(True))
    series = skew_join(grid.select(*cell, month, *values), starts.select(*cell).distinct(), cell, "left_semi")
    line = (
        series.withColumnsRenamed(named)
        .withColumn("_asked", F.lit(False))
        .unionByName(asked, allowMissingColumns=True)
        .withColumnsRenamed({v: k for k, v in named.items()})
        .groupBy(*cell, month)
        .agg(F.max("_asked").alias("_asked"), F.bool_or(~F.col("_asked")).alias("_known"), *[F.max(v).alias(v) for v in values])
    )
    order = Window.partitionBy(*cell).orderBy(month_index(F.col(month)))
    frames = {
        p.name(v): _AGGREGATES[_aggregate(p.stat)](F.col(v)).over(order.rangeBetween(p.first, p.end)) for p in periods for v in values
    }
    known = F.max("_known").over(order.rangeBetween(0, WINDOW_MONTHS - 1))
    wide = line.select(*cell, month, "_asked", known.alias("_known"), *[c.alias(n) for n, c in frames.items()])
    return wide.filter("_asked AND _known").drop("_asked", "_known").withColumnRenamed(month, start)


def assign_exposure(
    records: DataFrame, exposure: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Exposures of each record's point; records without one drop out."""
    return skew_join(records, exposure, keys)


def widen_exposure(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long → wide under the names ``{var}_{period}_{scheme}_{stat}``."""
    name = F.concat_ws("_", "var", "period", "scheme", "stat")
    return long.withColumn("_name", name).groupBy(*keys).pivot("_name", list(names)).agg(F.first("value"))


def lengthen_exposure(wide: DataFrame, keys: Sequence[str], values: Sequence[str], periods: Sequence[Period]) -> DataFrame:
    """Wide → long, the metadata back in columns."""
    cells = [
        F.struct(
            F.lit(v).alias("var"),
            F.lit(p.scheme).alias("scheme"),
            F.lit(p.period).alias("period"),
            F.lit(p.stat).alias("stat"),
            F.col(p.name(v)).alias("value"),
        )
        for p in periods
        for v in values
    ]
    return wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
