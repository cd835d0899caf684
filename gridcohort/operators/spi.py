"""Standardized precipitation index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import positive_part
from ..functions.special import gamma_cdf, normal_quantile
from .grid import KEYS, rolling_sum


def gamma_fit(x: Column, over) -> tuple[Column, Column, Column]:
    """Share of zeros, shape and scale of the positive values by Thom's closed form.

    Null shape where the positive values do not vary.
    """
    positive = F.when(x > 0, x)
    zero_share = F.avg(F.when(x.isNotNull(), (x <= 0).cast("double"))).over(over)
    mean = F.avg(positive).over(over)
    spread = F.log(mean) - F.avg(F.log(positive)).over(over)
    shape = F.when(spread > 1e-12, (1 + F.sqrt(1 + 4 * spread / 3)) / (4 * spread))
    return zero_share, shape, mean / shape


def spi(
    grid: DataFrame,
    value: str,
    scale: int,
    out: str | None = None,
    calib: tuple[int, int] | None = None,
    keys: Sequence[str] = KEYS,
    month: str = "month",
    clip: float = 3.09,
) -> DataFrame:
    """Index of the precipitation summed over ``scale`` months, per cell and calendar month.

    Gamma fit on the calibration years (all years by default), mixed with the share of zeros and
    mapped to a standard normal value. Negative amounts count as zero. The accumulation and the
    fit share one exchange on the cell.
    """
    out = out or f"spi{scale}"
    amount = grid.withColumn("_p", positive_part(value))
    summed = rolling_sum(amount, "_p", scale, "_x", keys, month)
    over = Window.partitionBy(*keys, F.month(month))
    x = F.col("_x")
    calibrated = F.when(F.year(month).between(*calib), x) if calib else x
    zero_share, shape, size = gamma_fit(calibrated, over)
    fitted = summed.withColumns({"_q": zero_share, "_shape": shape, "_scale": size})
    placed = fitted.withColumn("_cdf", gamma_cdf(F.col("_shape"), x / F.col("_scale")))
    h = F.col("_q") + (1 - F.col("_q")) * F.col("_cdf")
    # Beyond the clip the exact value does not matter; keep the argument inside (0, 1).
    inside = F.least(F.greatest(h, F.lit(1e-12)), F.lit(1 - 1e-12))
    score = F.least(F.greatest(normal_quantile(inside), F.lit(-clip)), F.lit(clip))
    return placed.withColumn(out, F.when(h.isNotNull(), score)).drop("_p", "_x", "_q", "_shape", "_scale", "_cdf")


def spi_scales(
    grid: DataFrame,
    value: str,
    scales: Sequence[int] = (1, 3, 6, 9, 12, 24, 48),
    calib: tuple[int, int] | None = None,
    keys: Sequence[str] = KEYS,
    month: str = "month",
) -> DataFrame:
    """One column per accumulation scale, still one exchange."""
    for k in scales:
        grid = spi(grid, value, k, f"spi{k}", calib, keys, month)
    return grid
