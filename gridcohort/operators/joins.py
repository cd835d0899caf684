"""Joins: skewed keys, cardinality checks, cells, nearest points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


# Rows of one key that a single task should take at most.
TARGET_ROWS = 2_000_000


def skew_join(fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a large frame to a lookup with few rows per key (inner, left, left_semi or left_anti).

    The frame with the many rows is on the left, where adaptive execution can split a partition
    that one key fills, by its actual bytes, and repeat the lookup's part for each piece; a small
    lookup is broadcast by its measured size. So no job runs before the join does. Needs
    ``spark.sql.adaptive.enabled``, which is Spark's default.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    return fact.join(lookup, list(on), how)


def hot_parts(df: DataFrame, keys: Sequence[str], rows: int = TARGET_ROWS) -> DataFrame:
    """(keys…, _parts): in how many parts the rows of a key go, for keys with more than ``rows`` rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > rows)
    return counts.select(*keys, F.ceil(F.col("_rows") / F.lit(rows)).cast("int").alias("_parts"))


def duplicate_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1")


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "m:1"
) -> DataFrame:
    """Join that raises when a side declared unique repeats a key."""
    sides = {"m:1": [("right", right)], "1:m": [("left", left)], "1:1": [("left", left), ("right", right)]}
    for name, side in sides[validate]:
        found = duplicate_keys(side, on).take(1)
        if found:
            raise ValueError(f"{name} side repeats the key {found[0].asDict()}")
    if validate == "1:m":
        # The right side has the many rows, so it goes to the left of the join.
        order = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
        matched = skew_join(right, left, on).select(*order)
        if how == "inner":
            return matched
        if how == "left":
            alone = left.join(right.select(*on), list(on), "left_anti")
            return matched.unionByName(alone, allowMissingColumns=True)
        return left.join(right, list(on), how)
    return skew_join(left, right, on, how)


def dedupe(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order.

    A minimum over structs merges partial results, so a key with very many rows costs no more
    than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in order_by if c not in keys]
    tail = [c for c in rest if c not in ordered]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered, *tail)).alias("_first"))
    return first.select(*[c if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def semi_anti_split(df: DataFrame, members: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is a member, rows whose key is not."""
    keys = members.select(*on).distinct()
    return skew_join(df, keys, on, "left_semi"), skew_join(df, keys, on, "left_anti")


# --- cells -----------------------------------------------------------------


def with_cell_index(
    df: DataFrame, step: float, lat: str = "lat", lon: str = "lon", lat0: float = -90.0, lon0: float = -180.0
) -> DataFrame:
    """Row and column of the raster cell that holds each point."""
    return df.withColumns(
        {
            "lat_idx": F.floor((F.col(lat) - F.lit(lat0)) / F.lit(step)).cast("int"),
            "lon_idx": F.floor((F.col(lon) - F.lit(lon0)) / F.lit(step)).cast("int"),
        }
    )


def cell_lookup(
    points: DataFrame, raster: DataFrame, step: float, how: str = "inner", lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Value of the raster cell under each point; raster rows are unique by (lat_idx, lon_idx)."""
    return skew_join(with_cell_index(points, step, lat, lon), raster, ["lat_idx", "lon_idx"], how)


def nearest_cell(points: DataFrame, grid: DataFrame, step: float, offset: float = 0.0, how: str = "left") -> DataFrame:
    """Value of the closest grid node; grid columns ``lat``/``lon`` become ``grid_lat``/``grid_lon``.

    Points and nodes meet by the whole number of steps, which no rounding of a coordinate can miss.
    """
    def index(c: str) -> Column:
        return F.rint(F.round((F.col(c) - F.lit(offset)) / F.lit(step), 9)).cast("long")

    nodes = grid.withColumnsRenamed({"lat": "grid_lat", "lon": "grid_lon"})
    nodes = nodes.withColumns({"_i": index("grid_lat"), "_j": index("grid_lon")})
    placed = points.withColumns({"_i": index("lat"), "_j": index("lon")})
    joined = skew_join(placed, nodes, ["_i", "_j"], how).drop("_i", "_j")
    return joined


def label_codes(df: DataFrame, code: str, labels: DataFrame, how: str = "inner") -> DataFrame:
    """Three label levels of a code: full, first two letters, first letter.

    ``labels`` has (code, label_3, label_2, label_1); codes without a row drop out of an inner join.
    """
    return skew_join(df, labels.withColumnRenamed("code", code), [code], how)


# --- nearest point ---------------------------------------------------------


def _gap(low: Column, size: float, x: Column) -> Column:
    """Distance on one axis from x to the interval [low, low + size]."""
    return F.greatest(low - x, x - (low + F.lit(size)), F.lit(0.0))


def _reach(low: Column, size: float, x: Column) -> Column:
    return F.greatest(F.abs(x - low), F.abs(x - (low + F.lit(size))))


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    max_distance: float,
    distance_col: str = "distance",
    right_id: str = "right_id",
    x: str = "lon",
    y: str = "lat",
    leaf: int = 64,
    max_depth: int = 24,
) -> DataFrame:
    """Left join to the closest right point within ``max_distance`` (planar degrees, ties by id).

    Search runs over distinct left positions. Each starts from the occupied cells of side
    ``max_distance`` around it. While some cell holds more than ``leaf`` right positions, all
    cells are halved and a position keeps only the sub-cells that can still hold its nearest
    point: those no farther than the smallest far corner of any. So a crowded cell is never
    paired in full with its visitors; the result is exact whatever the depth.
    """
    nodes = right.groupBy(F.col(x).cast("double").alias("rx"), F.col(y).cast("double").alias("ry")).agg(
        F.min(right_id).alias(right_id)
    )
    nodes = materialize(nodes)  # read once per level

    def cell(c: str, size: float) -> Column:
        return F.floor(F.col(c) / F.lit(size)).cast("long")

    def located(size: float) -> DataFrame:
        return nodes.withColumns({"cx": cell("rx", size), "cy": cell("ry", size)})

    # The crowding of all depths in one pass over the nodes.
    side = F.lit(max_distance) / F.pow(F.lit(2.0), F.col("d"))
    placed = nodes.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(max_depth - 1)))).select(
        "d", F.floor(F.col("rx") / side).alias("cx"), F.floor(F.col("ry") / side).alias("cy")
    )
    crowds = placed.groupBy("d", "cx", "cy").count().groupBy("d").agg(F.max("count").alias("most")).collect()
    depth = min([r["d"] for r in crowds if r["most"] <= leaf], default=max_depth if crowds else 0)

    positions = left.select(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).distinct()
    around = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    size = max_distance
    frontier = (
        positions.withColumn("dx", F.explode(around))
        .withColumn("dy", F.explode(around))
        .select("px", "py", (cell("px", size) + F.col("dx")).alias("cx"), (cell("py", size) + F.col("dy")).alias("cy"))
    )
    for level in range(depth):
        half = max_distance / 2 ** (level + 1)
        children = (
            located(half)
            .select("cx", "cy")
            .distinct()
            .groupBy(F.floor(F.col("cx") / 2).alias("ux"), F.floor(F.col("cy") / 2).alias("uy"))
            .agg(F.collect_set(F.struct("cx", "cy")).alias("inside"))
            .withColumnsRenamed({"ux": "cx", "uy": "cy"})
        )
        stepped = skew_join(frontier, children, ["cx", "cy"]).select(
            "px", "py", F.explode("inside").alias("c")
        )
        low_x, low_y = F.col("c.cx") * F.lit(half), F.col("c.cy") * F.lit(half)
        near = F.hypot(_gap(low_x, half, F.col("px")), _gap(low_y, half, F.col("py")))
        far = F.hypot(_reach(low_x, half, F.col("px")), _reach(low_y, half, F.col("py")))
        options = stepped.select("px", "py", "c.cx", "c.cy", near.alias("near"), far.alias("far"))
        # A position meets a bounded number of cells per level, so these groups stay small.
        packed = options.groupBy("px", "py").agg(
            F.min("far").alias("bound"), F.collect_list(F.struct("near", "cx", "cy")).alias("cells")
        )
        slack = F.lit(1.0 + 1e-9)
        frontier = (
            packed.select("px", "py", "bound", F.explode("cells").alias("c"))
            .filter((F.col("c.near") <= F.col("bound") * slack) & (F.col("c.near") <= F.lit(max_distance) * slack))
            .select("px", "py", "c.cx", "c.cy")
        )
    finest = located(max_distance / 2**depth)
    leaves = finest.groupBy("cx", "cy").agg(F.collect_list(F.struct("rx", "ry", right_id)).alias("inside"))
    pairs = skew_join(frontier, leaves, ["cx", "cy"]).select(
        "px", "py", F.explode("inside").alias("r")
    )
    gap = F.sqrt(F.pow(F.col("r.rx") - F.col("px"), 2) + F.pow(F.col("r.ry") - F.col("py"), 2))
    best = (
        pairs.select("px", "py", gap.alias("d"), F.col(f"r.{right_id}").alias("id"))
        .filter(F.col("d") <= max_distance)
        .groupBy("px", "py")
        .agg(F.min(F.struct("d", "id")).alias("best"))
        .select("px", "py", F.col("best.d").alias(distance_col), F.col("best.id").alias(right_id))
    )
    keyed = left.withColumns({"px": F.col(x).cast("double"), "py": F.col(y).cast("double")})
    return skew_join(keyed, best, ["px", "py"], "left").drop("px", "py")
