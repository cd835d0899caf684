"""User functions over the whole series of a cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.columns import month_index
from .stacked import changes


def apply_series(
    grid: DataFrame,
    value: str,
    fn: Callable[[np.ndarray], np.ndarray],
    out: str,
    keys: Sequence[str] = ("lat", "lon"),
    month: str = "month",
) -> DataFrame:
    """``grid`` with a column ``out``: ``fn`` over the series of each cell.

    ``fn`` gets the values of a cell as doubles, one for each calendar month from the cell's first
    to its last row, not a number where there is no row or no value, and returns as many. A cell
    without values is skipped: its results are null, as are results that are not numbers. Where a
    month has several rows, the last value by row order within the task counts for all of them.

    The grid is shuffled once by cell; a task holds one series and the Arrow batch it came in, many
    cells a batch. Rows without a month or a key column that is null form series like others.
    """
    keys = list(keys)
    columns = grid.columns
    dealt = grid.withColumn("_at", month_index(F.col(month)).cast("long")).repartition(*keys).sortWithinPartitions(*keys, "_at")

    def series(table: pa.Table, lo: int, hi: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        at, values = at[lo:hi], values[lo:hi]
        known = ~np.isnan(at)
        if not known.any() or np.isnan(values[known]).all():
            return np.full(hi - lo, np.nan)
        place = np.zeros(hi - lo, np.int64)
        place[known] = (at[known] - at[known][0]).astype(np.int64)
        whole = np.full(place[-1 if known[-1] else np.flatnonzero(known)[-1]] + 1, np.nan)
        whole[place[known]] = values[known]
        found = np.asarray(fn(whole), "float64")
        if found.shape != whole.shape:
            raise ValueError(f"the function of {out} returned {found.shape} values for {whole.shape}")
        return np.where(known, found[place], np.nan)

    def applied(table: pa.Table, ends: np.ndarray) -> pa.Table:
        at = table.column("_at").to_numpy(zero_copy_only=False).astype("float64")
        values = table.column(value).cast(pa.float64()).to_numpy(zero_copy_only=False)
        parts = [series(table, lo, hi, at, values) for lo, hi in zip(np.append(0, ends[:-1]), ends)]
        result = pa.array(np.concatenate(parts), from_pandas=True)
        return table.select(columns).append_column(out, result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            start = np.flatnonzero(changes(table.select(keys).to_pandas()))
            if len(start) > 1:  # the last series may go on
                yield from applied(table.slice(0, start[-1]), start[1:]).to_batches()
            held = table.slice(start[-1])
        if held is not None and held.num_rows:
            yield from applied(held, np.array([held.num_rows])).to_batches()

    schema = StructType([*grid.schema.fields, StructField(out, DoubleType())])
    return dealt.mapInArrow(run, schema)
