"""Many fixed-effects models in one pass over the records.

Models differ in outcome, regressors, sample and cell level, and share month, year and trend. Each
record carries a pattern: one bit for every model whose sample it is in. Records are dealt by the
tuple of their cells at all levels; every task adds up, for each tuple and pattern, the
cross-products within months of each block of variables, and for each month the sums of all
variables. Blocks are the variables of one specification; one that another holds is read off it.
Only these sums go on to the cells of the single levels, where a model takes the patterns with its
bit: products within months add up, and what lies between the parts of a month follows from their
means. So a record is moved once, whatever the number of models and levels, and a cell may hold any
share of the table, since parts of it add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

HEAD = 5  # rows, effects, cells, sum of y, sum of y²
MOST = 62  # models of one pass: bits of a pattern


@dataclass(frozen=True)
class Model:
    """Outcome, regressors, sample (rows with a null in a used column leave it), cell columns with
    the level each stands for, and the block of variables it belongs to."""

    y: str
    xs: tuple[str, ...]
    sample: Column | None
    cells: tuple[tuple[int, str], ...]
    block: int = 0


def packed(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m)


class Layout:
    """Places of variables, blocks and models in the vectors that tasks exchange."""

    def __init__(self, models: Sequence[Model], trends: int) -> None:
        self.models = [replace(m, sample=None) for m in models]  # goes to the tasks
        self.columns = list(dict.fromkeys(c for m in models for c in (*m.xs, m.y)))
        self.outcomes = list(dict.fromkeys(m.y for m in models))
        self.levels = list(dict.fromkeys(c for m in models for _, c in m.cells))
        place = {c: trends + i for i, c in enumerate(self.columns)}
        self.size = trends + len(self.columns)
        self.y_at = [place[y] for y in self.outcomes]
        self.used = [[*range(trends), *(place[x] for x in m.xs), place[m.y]] for m in models]
        joint: dict[int, set[int]] = {}
        for m, used in zip(models, self.used):
            joint.setdefault(m.block, set()).update(used)
        self.blocks: list[list[int]] = []
        for block in sorted(joint.values(), key=len, reverse=True):
            if not any(block <= set(b) for b in self.blocks):
                self.blocks.append(sorted(block))
        starts = np.concatenate([[0], np.cumsum([len(b) * (len(b) + 1) // 2 for b in self.blocks])]).astype(int)
        self.at = []
        for used in self.used:
            k = next(i for i, b in enumerate(self.blocks) if set(used) <= set(b))
            number = {c: i for i, c in enumerate(self.blocks[k])}
            square = np.zeros((len(number), len(number)), int)
            i, j = packed(len(number))
            square[i, j] = square[j, i] = starts[k] + np.arange(len(i))
            own = [number[c] for c in used]
            self.at.append(square[np.ix_(own, own)])


def changes(frame: pd.DataFrame) -> np.ndarray:
    """Where a row differs from the one before; nulls are equal to each other."""
    out = np.zeros(len(frame), bool)
    out[:1] = True
    for c in frame.columns:
        codes = pd.factorize(frame[c], use_na_sentinel=False)[0]
        out[1:] |= codes[1:] != codes[:-1]
    return out


def _parts(rows: DataFrame, layout: Layout, keys: list[str], names: list[str]) -> DataFrame:
    """(keys, _pattern, _month, _n, _sums): products within months (_month null), and sums of each month."""
    triangles = [packed(len(b)) for b in layout.blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = batch.select([*keys, "_pattern", "_month"]).to_pandas()
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            group = changes(labels[[*keys, "_pattern"]])
            start = np.flatnonzero(group | changes(labels[["_month"]]))
            n = np.diff(np.append(start, len(labels)))
            sums = np.add.reduceat(values, start, axis=0)
            squares = np.add.reduceat(values[:, layout.y_at] ** 2, start, axis=0)
            centred = values - np.repeat(sums / n[:, None], n, axis=0)
            first = np.flatnonzero(group)
            grams = []
            for a, b in zip(first, np.append(first[1:], len(labels))):
                of_block = [centred[a:b, block] for block in layout.blocks]
                grams.append(np.concatenate([(v.T @ v)[t] for v, t in zip(of_block, triangles)]))
            for at, month, count, sent in (
                (first, pa.nulls(len(first), pa.int32()), np.zeros(len(first)), grams),
                (start, batch.column("_month").take(pa.array(start)), n.astype(float), list(np.concatenate([sums, squares], axis=1))),
            ):
                kept = [batch.column(c).take(pa.array(at)) for c in (*keys, "_pattern")]
                yield pa.RecordBatch.from_arrays([*kept, month, pa.array(count), pa.array(sent, pa.list_(pa.float64()))], [*keys, "_pattern", "_month", "_n", "_sums"])

    fields = [rows.schema[c] for c in (*keys, "_pattern")]
    schema = StructType([*fields, StructField("_month", IntegerType()), StructField("_n", DoubleType()), StructField("_sums", ArrayType(DoubleType()))])
    # A hot cell is split over several tasks: its parts add up.
    dealt = rows.hint("rebalance", *keys).sortWithinPartitions(*keys, "_pattern", "_month")
    # Left out only here: a condition over many renamed columns makes the optimizer enumerate all
    # combinations of the names.
    return dealt.mapInArrow(run, schema).filter("_pattern <> 0")


class _Cell:
    """Sums of one cell of one level, over its parts."""

    def __init__(self, layout: Layout, chosen: list[tuple[int, int]], drop_singletons: bool) -> None:
        self.layout, self.chosen, self.alone = layout, chosen, drop_singletons
        self.within: dict[int, np.ndarray] = {}
        self.months: list[tuple[int, float, np.ndarray]] = []
        self.month: int | None = None
        self.heads = {j: np.zeros(HEAD) for j, _ in chosen}
        self.between = {j: 0.0 for j, _ in chosen}

    def add(self, pattern: int, month: float | None, n: float, sums: np.ndarray) -> None:
        if month is None or month != month:
            self.within[pattern] = self.within.get(pattern, 0.0) + sums
            return
        if month != self.month:
            self._end_month()
            self.month = month
        self.months.append((pattern, n, sums))

    def _end_month(self) -> None:
        if not self.months:
            return
        patterns, n, sums = (np.array(x) for x in zip(*self.months))
        size = self.layout.size
        for j in dict.fromkeys(j for j, _ in self.chosen):
            inside = (patterns >> j) & 1 == 1
            total = n[inside].sum()
            if not total or (self.alone and total == 1):
                continue
            used, y = self.layout.used[j], self.layout.outcomes.index(self.layout.models[j].y)
            part = sums[inside][:, used]
            apart = part / n[inside, None] - part.sum(axis=0) / total
            self.between[j] = self.between[j] + (apart * n[inside, None]).T @ apart
            self.heads[j] += [total, 1, 0, part[:, -1].sum(), sums[inside, size + y].sum()]
        self.months = []

    def stats(self) -> Iterator[tuple[int, int, np.ndarray]]:
        self._end_month()
        for j, level in self.chosen:
            if self.heads[j][0]:
                gram = self.between[j] + sum(v[self.layout.at[j]] for p, v in self.within.items() if p >> j & 1)
                self.heads[j][2] = 1.0
                yield j, level, np.concatenate([self.heads[j], gram[packed(len(gram))]])


def _cells(parts: DataFrame, layout: Layout, given: list[str], drop_singletons: bool) -> DataFrame:
    """(group…, _model, cell_level, _cell, stats) from the sums of the parts."""
    places = [F.struct(F.lit(i).alias("_level"), F.col(f"_c{i}").alias("_cell")) for i in range(len(layout.levels))]
    spread = parts.withColumn("_at", F.explode(F.array(*places))).select(*given, "_at.*", "_month", "_pattern", "_n", "_sums").filter("_cell IS NOT NULL")
    keys = [*given, "_level", "_cell"]
    chosen = [[(j, level) for j, m in enumerate(layout.models) for level, c in m.cells if c == column] for column in layout.levels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cell = None, None
        columns = [*given, "_model", "cell_level", "_cell", "stats"]

        def ended() -> list[tuple]:
            return [(*now[:-2], j, level, now[-1], stats) for j, level, stats in cell.stats()] if cell else []

        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = row[: len(keys)]
                if key != now:
                    out += ended()
                    now, cell = key, _Cell(layout, chosen[row[len(given)]], drop_singletons)
                month, pattern, n, sums = row[len(keys) :]
                cell.add(int(pattern), month, n, np.asarray(sums))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(ended(), columns=columns)

    fields = [parts.schema[g] for g in given]
    kinds = (("_model", IntegerType()), ("cell_level", IntegerType()), ("_cell", StringType()), ("stats", ArrayType(DoubleType())))
    dealt = spread.repartition(*keys).sortWithinPartitions(*keys, F.col("_month").asc_nulls_first(), "_pattern")
    return dealt.mapInPandas(run, StructType([*fields, *(StructField(n, k) for n, k in kinds)]))


def stacked_cells(
    df: DataFrame, models: Sequence[Model], trends: Sequence[Column], month: str, year: str, given: Sequence[str], drop_singletons: bool = False
) -> DataFrame:
    """(group…, _model, cell_level, _cell, stats): for each model and cell HEAD numbers, then the
    packed products of (trends, regressors, outcome) centred by month."""
    if len(models) > MOST:
        raise ValueError(f"at most {MOST} models in one pass")
    layout = Layout(models, len(trends))
    types = dict(df.dtypes)
    doubles = {c: F.col(c) if types[c] == "double" else F.col(c).cast("double") for c in layout.columns}
    pattern = F.lit(0).cast("long")
    for j, m in enumerate(models):
        used = list(dict.fromkeys([m.y, *m.xs]))
        known = sum((doubles[c] for c in used[1:]), doubles[used[0]]).isNotNull()
        inside = known if m.sample is None else known & F.coalesce(m.sample, F.lit(False))
        pattern = pattern.bitwiseOR(F.when(inside, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
    kept = df
    for c in dict.fromkeys([*given, month, year]):
        kept = kept.filter(F.col(c).isNotNull())
    names = [f"_v{i}" for i in range(layout.size)]
    rows = kept.select(
        *given,
        *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(layout.levels)],
        F.col(month).cast("int").alias("_month"),
        pattern.cast(LongType()).alias("_pattern"),
        *[t.alias(n) for t, n in zip(trends, names)],
        *[F.coalesce(doubles[c], F.lit(0.0)).alias(n) for c, n in zip(layout.columns, names[len(trends) :])],
    )
    keys = [*given, *(f"_c{i}" for i in range(len(layout.levels)))]
    return _cells(_parts(rows, layout, keys, names), layout, list(given), drop_singletons)
