"""Gamma and normal distribution functions that Spark SQL lacks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .columns import as_col

# Lanczos coefficients of the log-gamma function (g = 7, nine terms).
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)

# Rational approximation of the normal quantile (Acklam), relative error < 1.2e-9.
QUANTILE_A = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
QUANTILE_B = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
    6.680131188771972e01, -1.328068155288572e01,
)
QUANTILE_C = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
QUANTILE_D = (
    7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00,
)
QUANTILE_TAIL = 0.02425


def _horner(x: Column, coefficients, constant_one: bool = False) -> Column:
    """Polynomial, highest power first; ``constant_one`` appends a trailing 1."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out * x + F.lit(1.0) if constant_one else out


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the standard normal distribution function, null outside (0, 1)."""
    p = as_col(p)
    centre = p - F.lit(0.5)
    r = centre * centre
    middle = _horner(r, QUANTILE_A) * centre / _horner(r, QUANTILE_B, True)

    def tail(q: Column) -> Column:
        return _horner(q, QUANTILE_C) / _horner(q, QUANTILE_D, True)

    return (
        F.when((p <= 0) | (p >= 1), None)
        .when(p < QUANTILE_TAIL, tail(F.sqrt(-2 * F.log(p))))
        .when(p > 1 - QUANTILE_TAIL, -tail(F.sqrt(-2 * F.log(1 - p))))
        .otherwise(middle)
    )


def log_gamma_array(x: np.ndarray) -> np.ndarray:
    """log Γ(x) for x > 0, by the Lanczos sum at x + 1."""
    series = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series += c / (x + i)
    t = x + LANCZOS_G + 0.5
    return 0.5 * np.log(2 * np.pi) + (x + 0.5) * np.log(t) - t + np.log(series) - np.log(x)


# Shapes from which the expansion for large shapes is exact to 1e-11.
LARGE_SHAPE = 1e4
# Within this distance from the mean the expansion's coefficients come from their series.
NEAR = 0.02


def _large_shape_cdf(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Temme's uniform expansion of P(a, x), two terms; its error falls with a ** -2.5."""
    mu = (x - a) / a
    powers = sum((-mu) ** (k - 2) / k for k in range(2, 12))
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.where(np.abs(mu) < NEAR, mu * mu * powers, mu - np.log1p(mu))
        eta = np.sign(mu) * np.sqrt(2 * half)
        series = (-1 / 3 + eta / 12 - eta**2 * 2 / 135 + eta**3 / 864 + eta**4 / 2835, -1 / 540 - eta / 288)
        exact = (1 / mu - 1 / eta, 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu))
    near = np.abs(mu) < NEAR
    first, second = (np.where(near, s, e) for s, e in zip(series, exact))
    rest = np.exp(-a * half) / np.sqrt(2 * np.pi * a) * (first + second / a)
    erfc = np.frompyfunc(math.erfc, 1, 1)
    return 0.5 * erfc(-eta * np.sqrt(a / 2)).astype(float) - rest


def gamma_cdf_array(a: np.ndarray, x: np.ndarray, terms: int = 4000) -> np.ndarray:
    """Regularised lower incomplete gamma: power series below a + 1, continued fraction above, an
    expansion for large shapes. What does not settle within ``terms`` terms is not a number."""
    out = np.full(a.shape, np.nan)
    known = (a > 0) & (x >= 0) & np.isfinite(a)
    out[known & (x == 0)] = 0.0
    out[known & np.isinf(x)] = 1.0
    large = known & (x > 0) & (a >= LARGE_SHAPE) & np.isfinite(x)
    if large.any():
        out[large] = _large_shape_cdf(a[large], x[large])
    known = known & (a < LARGE_SHAPE) & np.isfinite(x)
    low = known & (x > 0) & (x < a + 1)
    high = known & (x >= a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1.0 / aa
        total = term.copy()
        for n in range(1, terms):
            term = term * xx / (aa + n)
            total += term
            if (settled := term <= total * 1e-16).all():
                break
        out[low] = np.where(settled, total * np.exp(aa * np.log(xx) - xx - log_gamma_array(aa)), np.nan)
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full_like(xx, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for n in range(1, terms):
            num = -n * (n - aa)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if (settled := np.abs(step - 1) < 1e-14).all():
                break
        out[high] = np.where(settled, 1 - h * np.exp(aa * np.log(xx) - xx - log_gamma_array(aa)), np.nan)
    return out


@F.pandas_udf(DoubleType())
def gamma_cdf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """P(shape, x). An iterative series has no built-in form; it runs on whole Arrow batches."""
    for shape, x in batches:
        values = gamma_cdf_array(shape.to_numpy("float64"), x.to_numpy("float64"))
        yield pd.Series(values).where(~np.isnan(values), None).astype("Float64")
