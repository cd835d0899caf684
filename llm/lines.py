"""Deduplication of repeated runs of lines.

A text is cut into chunks of lines where a rolling hash over the hashes of the last lines has a local
minimum, and inside a run of one line over and over at every other place. The places depend on those lines alone, so a passage that two documents share is cut alike
in both, wherever it stands, and no chunk has fewer than two lines (but where a text has just two). The two lines around a boundary
are looked up among those of all documents by their hash; they are the same only if their bytes are.
From the first place with the same lines (smallest doc_id, then row, then position) the match is
carried on line by line, by 128-bit digests of the lines, to the ends of both chunks, where the next
boundaries take over. The first place stays, all others are removed.

A run that stands earlier is found if a boundary lies inside it. Of runs of eight lines all but 0.3
in a hundred have one, of four lines two thirds, of two lines none but those of a single chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, id_order, store, with_row_ids

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def boundaries(lines: list[str]) -> list[int]:
    """0, the places between lines where a chunk ends and the next begins, and the number of lines."""
    h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    rolled = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]  # of the lines before and after a place
    rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX
    least = np.ones(len(rolled), bool)
    least[1:] &= rolled[1:] < rolled[:-1]
    least[:-1] &= rolled[:-1] < rolled[1:]
    # inside a run of one line over and over every other place is one
    fresh = np.append(True, rolled[1:] != rolled[:-1])
    since = np.arange(len(rolled)) - np.maximum.accumulate(np.where(fresh, np.arange(len(rolled)), 0))
    least |= (since > 0) & (since % 2 == 0)
    least[[0, -1]] = len(rolled) == 1  # the places beside the ends have no neighbour to be less than
    out = [0]
    for at in (np.flatnonzero(least) + 1).tolist():
        if at - out[-1] >= 2 or len(lines) == 2:
            out.append(at)
    return [*out, len(lines)]


def _core(lines: list[str], at: int) -> str | None:
    """The two lines around a boundary; None if they are blank."""
    pair = "\n".join(lines[at - 1 : at + 1])
    return None if not pair or pair.isspace() else pair


def places(rows: DataFrame) -> DataFrame:
    """rid, at, hash: the boundaries of each text with the hash of the lines around them."""

    def cut(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("rid", "at", "hash")}
        for rid, text in zip(batch["rid"], batch["text"]):
            lines = (text or "").split("\n")
            for at in boundaries(lines)[1:-1] if len(lines) > 1 else ():
                if (pair := _core(lines, at)) is not None:
                    value = xxhash.xxh64_intdigest(pair.encode("utf-8", "surrogatepass"))
                    for name, x in zip(out, (rid, at, value - (value >> 63 << 64))):
                        out[name].append(x)
        return {name: pa.array(v, pa.int64()) for name, v in out.items()}

    return arrow_map(rows, cut, "rid long, at long, hash long")


def candidates(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rid, doc_id, at, hash, core, before, after: the asked boundaries (rid, asked), the lines around them,
    and digests of the other lines of both chunks, those nearest to the boundary first."""

    def cut(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("rid", "doc_id", "at", "hash", "core", "before", "after")}
        for rid, doc_id, text, asked in zip(batch["rid"], batch["doc_id"], batch["text"], batch["asked"]):
            lines = text.split("\n")
            ends = boundaries(lines)
            number = {at: k for k, at in enumerate(ends)}
            for a in asked:
                at = a["at"]
                k = number[at]
                values = (rid, doc_id, at, a["hash"], _core(lines, at), _digests(lines[ends[k - 1] : at - 1][::-1]), _digests(lines[at + 1 : ends[k + 1]]))
                for name, x in zip(out, values):
                    out[name].append(x)
        kinds = (*[pa.int64()] * 4, pa.string(), *[pa.binary()] * 2)
        return {name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)}

    columns = "rid long, doc_id long, at long, hash long, core string, before binary, after binary"
    # the same plan at every size: without the hint a small table would be joined in another way
    return arrow_map(asked.hint("merge").join(rows, "rid"), cut, columns)


def _digests(lines: list[str]) -> bytes:
    return b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in lines)


def _same(a: bytes, b: bytes) -> int:
    """How many digests agree from the start."""
    n = 0
    while n < min(len(a), len(b)) and a[n : n + 16] == b[n : n + 16]:
        n += 16
    return n // 16


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_lines, n_removed, kept (text) of every row of `docs`.

    Null and empty texts have no lines. Only doc_id and text are read; repeated rows are documents
    like others, so all but the first lose the lines of their chunks. Null ids come last.
    """
    rows = with_row_ids(docs, "doc_id", "text")
    found = store(places(rows), "places")
    twice = found.groupBy("hash").agg(F.count("*").alias("times")).filter("times > 1").select("hash")
    asked = found.join(twice, "hash").groupBy("rid").agg(F.collect_list(F.struct("at", "hash")).alias("asked"))
    same = store(candidates(rows, asked), "candidates")
    place = F.struct(id_order().alias("o"), F.col("rid"), F.col("at"))
    # equal bytes, not only equal hashes
    firsts = same.groupBy("hash", "core").agg(F.min(F.struct(place.alias("place"), F.col("before"), F.col("after"))).alias("keep"), F.count("*").alias("times")).filter("times > 1")
    again = same.join(store(firsts, "firsts"), ["hash", "core"]).filter((F.col("rid") != F.col("keep.place.rid")) | (F.col("at") != F.col("keep.place.at")))

    def extend(batch: dict) -> dict:
        first, n = [], []
        for at, before, after, keep_before, keep_after in zip(*(batch[c] for c in ("at", "before", "after", "keep_before", "keep_after"))):
            up = _same(before, keep_before)
            first.append(at - 1 - up)
            n.append(2 + up + _same(after, keep_after))
        return {"rid": pa.array(batch["rid"], pa.int64()), "first": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64())}

    compared = again.select("rid", "at", "before", "after", F.col("keep.before").alias("keep_before"), F.col("keep.after").alias("keep_after"))
    runs = store(arrow_map(compared, extend, "rid long, first long, n long"), "runs")
    spans = runs.groupBy("rid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))

    def drop(batch: dict) -> dict:
        kept, lines_in, lost = [], [], []
        for text, spans in zip(batch["text"], batch["spans"]):
            lines = text.split("\n") if text else []
            gone = {i for s in spans or () for i in range(s["first"], s["first"] + s["n"])}
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
            lines_in.append(len(lines))
            lost.append(len(gone))
        return {
            "rid": pa.array(batch["rid"], pa.int64()), "doc_id": pa.array(batch["doc_id"], pa.int64()),
            "n_lines": pa.array(lines_in, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept": pa.array(kept, pa.string()),
        }

    return arrow_map(rows.join(spans.hint("merge"), "rid", "left"), drop, "rid long, doc_id long, n_lines long, n_removed long, kept string")
