"""Removal of long byte strings that occur elsewhere, by a logarithmic family of suffix arrays.

Suffixes are sampled: the window sampling of `llm.windows` picks a start in every string of 200
bytes, the same in equal strings. The documents come in batches. A batch's suffix array is a table
of its sampled suffixes in the order of the hash of their first K bytes, equal ones as one entry
with their number. It is merge-scanned (a sort-merge join) against each level of the family, which
finds the suffixes that share their first K bytes with an older one. Then it becomes a level, and
levels of equal size merge, so that n batches leave log n levels and an entry is rewritten log n
times.

Only occurrences of suffixes found this way can lie in a repeated string of 200 bytes. For them the
match is followed to both sides through phrases and windows (`llm.repeats`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, store, with_row_ids
from llm.repeats import PHRASES, covered_windows, flags, phrases
from llm.windows import covered

LENGTH, K = 200, 100
BATCHES = 4


def octets(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


class Family:
    """Suffix arrays of sizes that double: (rank, entries); two of a rank become one of the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.found: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch of sampled suffixes (anchor) and note those that occur twice by now."""
        batch = store(self._array(suffixes.groupBy("anchor").agg(F.count("*").alias("n"))), "suffixes")
        self.found.append(batch.filter("n > 1").select("anchor"))
        for _, level in self.levels:
            self.found.append(store(batch.join(level.select("anchor"), "anchor").select("anchor"), "matches"))
        rank = 0
        while self.levels and self.levels[-1][0] == rank:
            _, level = self.levels.pop()
            batch = store(self._array(batch.union(level).groupBy("anchor").agg(F.sum("n").alias("n"))), "suffixes")
            rank += 1
        self.levels.append((rank, batch))

    @staticmethod
    def _array(entries: DataFrame) -> DataFrame:
        return entries.sortWithinPartitions("anchor")

    def repeated(self) -> DataFrame:
        """anchor: the distinct suffix starts that occur more than once in all batches."""
        out = self.found[0]
        for f in self.found[1:]:
            out = out.union(f)
        return out.distinct()


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, k: int = K, batches: int = BATCHES, most: int = PHRASES) -> DataFrame:
    """rid, doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row of `docs`.

    Removed is each byte of a `length`-byte string that also starts elsewhere, in the same or in
    another row; a repeated row loses all its bytes if it has `length` or more. Null counts as
    empty, shorter texts lose nothing. The rest of a text need not be valid UTF-8. Only doc_id and
    text are read.
    """
    rows = with_row_ids(docs, "doc_id", "text", F.lit(0).cast("long").alias("ord"))
    family, w = Family(), length - k + 1
    for b in range(batches):
        part = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == b)
        family.add(phrases(part, octets, k, w).select("anchor"))
    repeated = store(family.repeated(), "repeated")
    found = store(phrases(rows, octets, k, w).join(repeated, "anchor"), "found")
    marks = covered_windows(found, rows, octets, length, "anywhere", most)

    def drop(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, spans, points in zip(batch["text"], batch["spans"], batch["points"]):
            b = octets(text or "")
            if spans or points:
                gone = covered(flags(spans, points, len(b) - length + 1), length)
                edges = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                values = (len(b), int(gone.sum()), int((edges == 1).sum()), b[~gone].tobytes())
            else:
                values = (len(b), 0, 0, b.tobytes())
            for name, v in zip(out, values):
                out[name].append(v)
        ids = {n: pa.array(batch[n], pa.int64()) for n in ("rid", "doc_id")}
        return ids | {n: pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")} | {"kept": pa.array(out["kept"], pa.binary())}

    columns = "rid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return arrow_map(rows.drop("ord").join(marks, "rid", "left"), drop, columns)
