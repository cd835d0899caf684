"""Stretches of words that repeat with a period, found online by catchers over dyadic blocks.

A square is a stretch xx; `SquareCatcher` reads a sequence word by word, or in pieces of any length,
and reports the squares that the new words complete. As soon as a block of 2**k words is complete,
a catcher is set over it. It watches for the block's words to come again at a distance of 2 * 2**k
to 4 * 2**k - 1: every square whose x has such a length holds a whole block in its first half, and
the block's copy in its second. Each new word ends one string of 2**k words, which two catchers of
that size still watch for, so a word costs two comparisons a size. On a hit, suffixes are compared
backwards from the block and its copy, and what follows them forwards. Squares of one stretch and
period are one run, which later words make longer.

Words are compared by hashes of whole strings, and every run is compared word by word at the end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from llm.windows import mix, powers

#: Bytes of text whose words are looked at together; a longer text is looked at alone.
PIECE = 4 << 20
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


class SquareCatcher:
    """Runs of a growing sequence of word numbers: stretches of length 2 * period or more that no neighbour extends."""

    def __init__(self) -> None:
        self.words = np.empty(0, np.int64)
        self._sums = np.zeros(1, np.uint64)
        self._runs = np.empty((0, 3), np.int64)  # start, end, period
        self._open = self._runs  # stretches that reach the last word, squares or not yet

    def append(self, words: np.ndarray) -> np.ndarray:
        """Read on; return rows (start, end, period) of the runs that hold a square which ends in `words`."""
        old, n = len(self.words), len(self.words) + len(words)
        pw, self._inverse = powers(n)
        units = mix(np.asarray(words).astype(np.uint64) + np.uint64(1))
        self.words = np.concatenate([self.words, words])
        new = np.cumsum(units * pw[old:n], dtype=np.uint64)
        self._sums = np.concatenate([self._sums, self._sums[-1] + new])
        found = [self._grown()]
        size = 1
        while size == 1 or 3 * size <= n:
            found.append(self._caught(size, old, n))
            size *= 2
        now, self._open = self._settled(np.unique(np.concatenate(found), axis=0))
        self._runs = _smallest_periods(np.concatenate([self._runs[self._runs[:, 1] < old], now]))
        return now[now[:, 1] > old]

    def runs(self) -> Runs:
        """start, end (exclusive) and smallest period of each run, by start, then period."""
        order = np.lexsort((self._runs[:, 2], self._runs[:, 0]))
        start, end, period = self._runs[order].T
        return start, end, period

    def _hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self._sums[hi] - self._sums[lo]) * self._inverse[lo]

    def _grown(self) -> np.ndarray:
        """Stretches that reached the last word before, as far as they go now."""
        start, end, period = self._open.T
        return np.stack([start, end + self._forward(end - period, end), period], axis=1)

    def _caught(self, size: int, old: int, n: int) -> np.ndarray:
        """Stretches around the hits of all catchers over blocks of `size` words, for copies that end in the new words."""
        at = np.arange(max(size, old - size + 1), n - size + 1)
        blocks = np.arange(0, n - size + 1, size)
        set_on, copies, number = self._hash(blocks, blocks + size), self._hash(at, at + size), at // size
        first, second = [], []
        for back in (1, 2, 3) if size == 1 else (2, 3):
            hit = np.flatnonzero((number >= back) & (set_on[np.maximum(number - back, 0)] == copies))
            first.append((number[hit] - back) * size)
            second.append(at[hit])
        a, b = np.concatenate(first), np.concatenate(second)
        if not len(a):
            return np.empty((0, 3), np.int64)
        order = np.lexsort((a, b - a))
        a, b = a[order], b[order]
        # blocks side by side with copies side by side lie in one stretch
        new = np.ones(len(a), bool)
        new[1:] = (np.diff(b - a) != 0) | (np.diff(a) != size)
        a, b = a[new], b[new]
        start = a - self._backward(a, b)
        end = b + self._forward(a, b)
        some = (end - start >= 2 * (b - a)) | (end == n)
        return np.stack([start[some], end[some], (b - a)[some]], axis=1)

    def _backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the words before a and before b (a < b)."""
        got = np.zeros(len(a), np.int64)
        step = 1 << int(a.max(initial=0)).bit_length()
        while step := step >> 1:
            more = got + step
            open_ = np.flatnonzero(more <= a)
            x, y, m = a[open_], b[open_], more[open_]
            got[open_[self._hash(x - m, x) == self._hash(y - m, y)]] += step
        return got

    def _forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the words from a and from b on (a < b)."""
        got, room = np.zeros(len(a), np.int64), len(self.words) - b
        step = 1 << int(room.max(initial=0)).bit_length()
        while step := step >> 1:
            more = got + step
            open_ = np.flatnonzero(more <= room)
            x, y, m = a[open_], b[open_], more[open_]
            got[open_[self._hash(x, x + m) == self._hash(y, y + m)]] += step
        return got

    def _settled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs among the stretches, and the stretches that can still grow; both compared word by word."""
        n = len(self.words)
        runs = _smallest_periods(rows[rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2]])
        going = rows[rows[:, 1] == n]
        for start, _, period in runs[runs[:, 1] == n].tolist():  # multiples of its period end where the run ends
            going = going[(going[:, 0] < start) | (going[:, 2] % period != 0) | (going[:, 2] == period)]
        if all(np.array_equal(self.words[s : e - p], self.words[s + p : e]) for s, e, p in np.concatenate([runs, going]).tolist()):
            return runs, going
        true = np.unique(np.concatenate([self._unequal(*row) for row in rows.tolist()]), axis=0)
        return _smallest_periods(true[true[:, 1] - true[:, 0] >= 2 * true[:, 2]]), true[true[:, 1] == n]

    def _unequal(self, start: int, end: int, period: int) -> np.ndarray:
        """The true stretches of a period in place of one whose hashes may have taken unequal words for equal."""
        words = self.words[start:end]
        cut = np.flatnonzero(words[:-period] != words[period:]) + start
        lo, hi = np.append(start - 1, cut) + 1, np.append(cut, end - period) + period
        some = (hi - lo >= 2 * period) | (hi == len(self.words)) & (hi > lo + period)
        return np.stack([lo[some], hi[some], np.full(some.sum(), period)], axis=1)


def _smallest_periods(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) of one stretch the one with the smallest period: the others are its multiples."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
    return rows[first]


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that gives a tenth of the documents a periodic end; None for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and the words of all texts; split by space, tab, LF, VT, FF and CR."""
    parts = pc.ascii_split_whitespace(texts.fill_null(b"").cast(pa.large_binary()).view(pa.large_string()))
    some = pc.greater(pc.binary_length(parts.flatten()), 0)
    number = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return number[parts.offsets.to_numpy() - parts.offsets[0].as_py()], parts.flatten().filter(some)


def _piece(ids: pa.Array, texts: pa.Array, exponent: int, least: int, order: Callable[[int | None, int], np.ndarray | None] | None) -> pa.RecordBatch:
    offsets, words = _words(texts)
    take = np.arange(len(words))
    for i, (doc_id, lo, hi) in enumerate(zip(ids.to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist())):
        at = order(doc_id, hi - lo) if order else None
        if at is not None:
            take[lo:hi] = lo + at
    words = words.take(pa.array(take))
    codes = words.dictionary_encode()
    # a word of its own after each text: no run crosses it
    count = len(offsets) - 1
    sequence = np.insert(codes.indices.to_numpy().astype(np.int64), offsets[1:], len(codes.dictionary) + np.arange(count))
    catcher = SquareCatcher()
    catcher.append(sequence)
    start, end, period = catcher.runs()
    long = end - start >= np.maximum(least, exponent * period)
    start, end, period = start[long], end[long], period[long]
    begin = offsets[:-1] + np.arange(count)  # of each text in the sequence
    text = np.searchsorted(begin, start, "right") - 1
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, start + period - text, 1)
    np.add.at(gone, end - text, -1)
    kept = np.cumsum(gone[:-1]) == 0
    to = np.concatenate([[0], np.cumsum(kept)])[offsets]
    rest = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(to, pa.int64()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    bounds = np.searchsorted(text, np.arange(count + 1))
    runs = [[(int(s - begin[i]), int(e - s), int(p)) for s, e, p in zip(start[a:b], end[a:b], period[a:b])] for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))]
    return pa.RecordBatch.from_pydict({
        "doc_id": ids,
        "n_words": pa.array(np.diff(offsets), pa.int64()),
        "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs], pa.list_(RUN)),
        "collapsed": rest.view(pa.large_binary()).cast(pa.binary()),
    })


RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6, order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row of `docs`.

    A run is a stretch of words with smallest period p, at least `least` words and `exponent` * p
    (2 or more) long, that no neighbouring word extends. `collapsed` has the words outside the runs
    and the first p words of each run, joined by single spaces, as UTF-8. A null text has no words; null and repeated ids
    stay as they are, each row is looked at for itself. `order` may deal a text's words anew before
    the search. Only doc_id and text are read.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period at least once")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PIECE, "right")))
                yield _piece(batch.column("doc_id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo), exponent, least, order)
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, and digests of all runs and of the collapsed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            best = [max(x, key=_rank, default=None) for x in runs]
            listed = ["".join(f"{r['start']},{r['length']},{r['period']}\n" for r in x) for x in runs]
            out = {"doc_id": batch.column("doc_id"), "n_runs": pa.array([len(x) for x in runs], pa.int64())}
            for name in ("start", "length", "period"):
                out[name] = pa.array([b and b[name] for b in best], pa.int64())
            out["exponent_milli"] = pa.array([b and 1000 * b["length"] // b["period"] for b in best], pa.int64())
            out["runs_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed])
            out["collapsed_sha256"] = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("collapsed")])
            out["n_words"] = batch.column("n_words")
            yield pa.RecordBatch.from_pydict(out)

    columns = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long"
    return found.mapInArrow(run, columns)


class _rank:
    """Order of runs: exponent, compared exactly, then the smaller start, then the smaller period."""

    def __init__(self, run: dict) -> None:
        self.run = run

    def __lt__(self, other: _rank) -> bool:
        a, b = self.run, other.run
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (x, -a["start"], -a["period"]) < (y, -b["start"], -b["period"])
