"""Fixed-effects least squares with clustered errors, from cross-products per cell.

Model: y ~ x + cell:year trend + cell x calendar-month effects, errors clustered by cell. All
absorbed terms are nested in the cell, so everything the estimate needs is a small matrix per
cell: cross-products of (trend, x, y) centred by (cell, month), with the trend swept out.
Coefficients follow from the sum over cells, clustered errors from each cell's own matrix.
The rows are read once, merged from partial sums (a cell may hold any share of the table), and
neither residuals nor demeaned rows are ever written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..session import materialize
from .stacked import HEAD, MOST, Model, packed as _packed, stacked_cells

# Up to this many variables the cross-products are one built-in aggregation.
NATIVE_LIMIT = 10
_ALL = "_all"


def _unpack(values: np.ndarray, m: int) -> np.ndarray:
    full = np.zeros((m, m))
    i, j = _packed(m)
    full[i, j] = values
    full[j, i] = values
    return full


def _frames(rows: Iterator[tuple], columns: list[str], size: int = 256) -> Iterator[pd.DataFrame]:
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) == size:
            yield pd.DataFrame(buffer, columns=columns)
            buffer = []
    if buffer:
        yield pd.DataFrame(buffer, columns=columns)


def _schema(df: DataFrame, keys: Sequence[str], *arrays: str) -> StructType:
    fields = [StructField(k, df.schema[k].dataType) for k in keys]
    return StructType(fields + [StructField(a, ArrayType(DoubleType())) for a in arrays])


def _native_cells(base: DataFrame, group: list[str], names: list[str], drop_singletons: bool) -> DataFrame:
    """Stats per (group, cell): HEAD numbers, then the packed centred cross-products."""
    i, j = _packed(len(names))
    pairs = [(names[a], names[b]) for a, b in zip(i, j)]
    n = F.count("*")
    inner = base.groupBy(*group, "_cell", "_month").agg(
        n.alias("n"),
        F.sum("_y").alias("sy"),
        F.sum(F.col("_y") * F.col("_y")).alias("syy"),
        *[(F.covar_pop(a, b) * n).alias(f"g{k}") for k, (a, b) in enumerate(pairs)],
    )
    if drop_singletons:
        inner = inner.filter("n > 1")
    totals = inner.groupBy(*group, "_cell").agg(
        F.sum("n").cast("double").alias("n"),
        F.count("*").cast("double").alias("levels"),
        F.sum("sy").alias("sy"),
        F.sum("syy").alias("syy"),
        *[F.sum(f"g{k}").alias(f"g{k}") for k in range(len(pairs))],
    )
    head = [F.col("n"), F.col("levels"), F.lit(1.0), F.col("sy"), F.col("syy")]
    return totals.select(*group, "_cell", F.array(*head, *[F.col(f"g{k}") for k in range(len(pairs))]).alias("stats"))


def _sweep(gram: np.ndarray, first: int) -> np.ndarray:
    """Remove the first variables (years, so in whole units) from all others, if they vary."""
    size = gram.diagonal()[:first].copy()
    for a in range(first):
        pivot = gram[a, a]
        if pivot > 1e-9 * size[a] and pivot > 1e-6:
            gram = gram - np.outer(gram[:, a], gram[a, :]) / pivot
    return gram[first:, first:]


def vector_sums(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Element-wise sum of array columns of one length: summed inside each task's batches first, so
    that only a few arrays per task are taken apart."""

    def summed(batches):
        totals: dict[tuple, np.ndarray] = {}

        def flush():
            frame = pd.DataFrame([(*k, v) for k, v in totals.items()], columns=[*by, column])
            totals.clear()
            return frame

        for batch in batches:
            for row in batch.itertuples(index=False):
                key, values = row[:-1], np.asarray(row[-1], "float64")
                if key in totals:
                    totals[key] += values
                else:
                    totals[key] = values.copy()
            if len(totals) > 200:
                yield flush()
        if totals:
            yield flush()

    df = df.select(*by, column)
    df = df.mapInPandas(summed, df.schema)
    parts = df.select(*by, F.posexplode(column)).groupBy(*by, "pos").agg(F.sum("col").alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return parts.groupBy(*by).agg(F.transform(ordered, lambda x: x["s"]).alias(column))


def _solve(stats: np.ndarray, k: int, tolerance: float = 1e-9):
    """Coefficients, inverse cross-products and R² numbers; collinear terms are dropped in order."""
    gram = _unpack(stats[HEAD:], k + 1)
    a, b = gram[:k, :k], gram[:k, k]
    left = a.copy()
    keep = []
    for i in range(k):
        pivot = left[i, i]
        if a[i, i] > 1e-12 and pivot > tolerance * a[i, i]:
            keep.append(i)
            left = left - np.outer(left[:, i], left[i, :]) / pivot
    beta, inverse = np.full(k, np.nan), np.zeros((k, k))
    if keep:
        scale = 1 / np.sqrt(a.diagonal()[keep])
        core = np.linalg.inv(a[np.ix_(keep, keep)] * np.outer(scale, scale)) * np.outer(scale, scale)
        inverse[np.ix_(keep, keep)] = core
        beta[keep] = core @ b[keep]
    rss = gram[k, k] - np.nansum(beta * b)
    n, sy, syy = stats[0], stats[3], stats[4]
    tss = syy - sy * sy / n if n else np.nan
    return beta, inverse, max(rss, 0.0), tss


def _doubles(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns as double under their own names; no renaming, which keeps plans small."""
    types = dict(df.dtypes)
    return [F.col(c) if types[c] == "double" else F.col(c).cast("double").alias(c) for c in columns]


def _trends(year: str, trend: str) -> list[Column]:
    since = F.col(year).cast("double") - 2000.0
    return {"none": [], "linear": [since], "quadratic": [since, since * since]}[trend]


def _order(values: int) -> int:
    """Variables of a packed matrix with this many entries after the HEAD."""
    return int(((8 * (values - HEAD) + 1) ** 0.5 - 1) / 2 + 0.5)


def _status(beta: float, n: float, used: int, clusters: float) -> str:
    if np.isnan(beta):
        return "collinear"
    if clusters < 2:
        return "one cluster"
    return "ok" if n > used else "no degrees of freedom"


def _estimate(cells: DataFrame, keys: list[str], terms: Sequence[Sequence[str]], p: int, correction: bool) -> DataFrame:
    """Coefficients per key from stats per (key, _cell), the first ``p`` variables being trends.

    ``terms`` has the regressors of each model; with several, the key ``_model`` says which.
    """
    def swept(batches):
        def rows():
            for batch in batches:
                for *key, _, stats in batch[[*keys, "_cell", "stats"]].itertuples(index=False):
                    stats = np.asarray(stats, "float64")
                    if stats[0] > 0:
                        left = _sweep(_unpack(stats[HEAD:], _order(len(stats))), p)
                        yield (*key, np.concatenate([stats[:HEAD], left[_packed(len(left))]]))

        yield from _frames(rows(), [*keys, "stats"])

    # One matrix per cell serves the coefficients and the errors: keep it, read the rows once.
    reduced = materialize(cells.mapInPandas(swept, _schema(cells, keys, "stats")))
    totals = vector_sums(reduced, keys, "stats")

    def solved(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                stats = np.asarray(row[-1])
                beta, inverse, rss, tss = _solve(stats, _order(len(stats)) - 1)
                fit = [stats[0], stats[1], stats[2], 1 - rss / tss if tss else np.nan]
                out.append((*row[:-1], beta, inverse.ravel(), fit))
            yield pd.DataFrame(out, columns=[*keys, "beta", "inverse", "fit"])

    fits = totals.mapInPandas(solved, _schema(cells, keys, "beta", "inverse", "fit"))

    # Every cell needs its group's coefficients. There is one row per group: Spark broadcasts it
    # by its measured size, or splits a group with most of the cells.
    scored = reduced.join(fits.select(*keys, "beta"), keys).select(*keys, "stats", "beta")

    def meats(batches):
        totals = {}

        def flush():
            frame = pd.DataFrame([(*g, v) for g, v in totals.items()], columns=[*keys, "meat"])
            totals.clear()
            return frame

        for batch in batches:
            for row in batch.itertuples(index=False):
                beta = np.nan_to_num(np.asarray(row[-1], "float64"))
                k = len(beta)
                gram = _unpack(np.asarray(row[-2])[HEAD:], k + 1)
                score = gram[:k, k] - gram[:k, :k] @ beta
                total = totals.setdefault(row[:-2], np.zeros(k * k))
                total += np.outer(score, score).ravel()
            if len(totals) > 200:
                yield flush()
        if totals:
            yield flush()

    meat = vector_sums(scored.mapInPandas(meats, _schema(cells, keys, "meat")), keys, "meat")
    model_at = keys.index("_model") if "_model" in keys else None

    def finished(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                *key, beta, inverse, fit, middle = row
                beta = np.asarray(beta, "float64")
                k = len(beta)
                inv = np.asarray(inverse).reshape(k, k)
                n, _, clusters, r2 = fit
                used = int(np.isfinite(beta).sum())
                factor = 1.0
                if correction:
                    ok = clusters > 1 and n > used
                    factor = clusters / (clusters - 1) * (n - 1) / (n - used) if ok else np.nan
                v = factor * inv @ np.asarray(middle).reshape(k, k) @ inv
                se = np.where(np.isfinite(beta), np.sqrt(np.maximum(v.diagonal(), 0)), np.nan)
                names = terms[0 if model_at is None else int(key[model_at])]
                for i in range(k):
                    out.append((*key, names[i], used, _status(beta[i], n, used, clusters), [beta[i], se[i], n, r2, clusters]))
            yield pd.DataFrame(out, columns=[*keys, "term", "rank", "status", "_v"])

    schema = _schema(cells, keys)
    added = (("term", StringType()), ("rank", IntegerType()), ("status", StringType()), ("_v", ArrayType(DoubleType())))
    schema = StructType([*schema.fields, *(StructField(n, t) for n, t in added)])
    rows = fits.join(meat, keys).select(*keys, "beta", "inverse", "fit", "meat").mapInPandas(finished, schema)

    def at(i: int):
        return F.when(~F.isnan(F.col("_v")[i]), F.col("_v")[i])

    coef, se = at(0), at(1)
    return rows.select(
        *keys,
        "term",
        coef.alias("coef"),
        se.alias("se"),
        F.when(se > 0, coef / se).alias("t"),
        F.col("_v")[2].cast("long").alias("n"),
        at(3).alias("r2"),
        F.col("_v")[4].cast("long").alias("n_clusters"),
        "rank",
        "status",
    )


def fe_ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    cell: str,
    month: str,
    year: str,
    trend: str = "linear",
    group: Sequence[str] | None = None,
    drop_singletons: bool = False,
    correction: bool = True,
    native_limit: int = NATIVE_LIMIT,
) -> DataFrame:
    """Coefficients (group…, term, coef, se, t, n, r2, n_clusters, rank, status), one row per regressor.

    ``trend``: ``linear`` or ``quadratic`` per cell, or ``none``. ``group`` runs one model per
    combination of group values, all in the same job. Rows with a null in a used column leave.
    A collinear regressor keeps its row with a null coefficient. ``correction`` applies
    G/(G-1) · (N-1)/(N-K) to the clustered variance. ``rank`` counts the regressors that stay;
    ``status`` says why a number is null: ``collinear``, ``one cluster`` or ``no degrees of freedom``.
    """
    xs = list(dict.fromkeys(xs))
    trends = _trends(year, trend)
    given = list(group or [])
    keys = given or [_ALL]
    names = [*[f"_t{i}" for i in range(len(trends))], *xs]
    if len(names) >= native_limit:
        one = Model(y, tuple(xs), None, ((1, cell),))
        cells = stacked_cells(df, [one], trends, month, year, given, drop_singletons).withColumn(_ALL, F.lit(0))
        return _estimate(cells, keys, [xs], len(trends), correction).drop(_ALL)
    kept = df
    for c in dict.fromkeys([*given, cell, month, year, *xs, y]):
        kept = kept.filter(F.col(c).isNotNull())
    base = kept.select(
        *given,
        *([] if given else [F.lit(0).alias(_ALL)]),
        F.col(cell).alias("_cell"),
        F.col(month).alias("_month"),
        *[t.alias(n) for t, n in zip(trends, names)],
        *_doubles(df, xs),
        F.col(y).cast("double").alias("_y"),
    )
    cells = _native_cells(base, keys, [*names, "_y"], drop_singletons)
    return _estimate(cells, keys, [xs], len(trends), correction).drop(_ALL)


def fe_models(
    df: DataFrame,
    models: Sequence[Model],
    month: str,
    year: str,
    trend: str = "linear",
    group: Sequence[str] | None = None,
    drop_singletons: bool = False,
    correction: bool = True,
) -> DataFrame:
    """Many models over one reading of the records: (group…, model, cell_level, term, coef, …), where
    ``model`` is the place in the list. A model without rows in a group has no rows here."""
    trends, given = _trends(year, trend), list(group or [])
    out = []
    for first in range(0, len(models), MOST):
        some = models[first : first + MOST]
        cells = stacked_cells(df, some, trends, month, year, given, drop_singletons)
        found = _estimate(cells, [*given, "_model", "cell_level"], [m.xs for m in some], len(trends), correction)
        out.append(found.withColumn("_model", F.col("_model") + first).withColumnRenamed("_model", "model"))
    return reduce(DataFrame.unionByName, out)
