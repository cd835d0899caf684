"""Near duplicates by SimHash fingerprints that meet at the anchors of a covering code.

Anchors are the words of the perfect binary Golay code of length 23: every 23-bit word lies within
3 bits of exactly one anchor. 23 fingerprint bits (or two times 23, for very many fingerprints)
are compared with it. If two fingerprints differ in 2 bits or fewer, then the anchor nearest to the
one lies within 3 + 2 bits of the other. So each distinct fingerprint is 'home' at its nearest
anchor and a 'guest' at every anchor within covering radius plus threshold, about 22, and per
anchor the home fingerprints are compared with the guests.

Rows of equal fingerprint are combined first. An anchor's group with many homes is dealt to slots:
each slot has a bounded number of homes and all guests, in turn read in bounded batches. What a
group gives is a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, id_order, is_scan, rows_of, store, with_row_ids
from llm.components import components

SEED = 42
THRESHOLD = 2
#: Generator of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY = 0xAE3
LENGTH, CHECK_BITS, RADIUS = 23, 11, 3
#: Home fingerprints in a slot.
HOMES = 4096
#: From so many distinct fingerprints on, two blocks of 23 bits choose among 2**24 anchors.
TWO_BLOCKS = 1 << 24


def fingerprint(text: str | None) -> int:
    """SimHash of the hashes of 3-word shingles, A-Z lower-cased; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ones, total = np.zeros(64, np.int64), max(1, len(words) - 2)
    for start in range(0, total, 100_000):
        part = words[start : start + 100_002]
        shingles = map(b" ".join, zip(part, part[1:], part[2:])) if len(words) > 2 else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes that are made already, each counted as often as it is given; 0 for none."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 100_000):
        part = np.ascontiguousarray(hashes[start : start + 100_000])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _remainders() -> np.ndarray:
    """Of x**i divided by the generator, for each bit i."""
    out = []
    for i in range(LENGTH):
        r = 1 << i
        for top in range(LENGTH - 1, CHECK_BITS - 1, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - CHECK_BITS)
        out.append(r)
    return np.array(out, np.int64)


def error_table() -> list[list[np.ndarray]]:
    """Per remainder: errors of weight 0..RADIUS + THRESHOLD, by weight."""
    rem = _remainders()
    table: list[list[list[int]]] = [[[] for _ in range(RADIUS + THRESHOLD + 1)] for _ in range(1 << CHECK_BITS)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for bits in combinations(range(LENGTH), weight):
            r = 0
            for b in bits:
                r ^= int(rem[b])
            table[r][weight].append(sum(1 << b for b in bits))
    return [[np.array(e, np.int64) for e in by] for by in table]


class Anchors:
    """Anchors of 23 bits and the number of bits between."""

    def __init__(self) -> None:
        self.rem, table = _remainders(), error_table()
        self.errors = [np.concatenate(by) for by in table]
        self.weights = [np.repeat(np.arange(len(by)), [len(e) for e in by]) for by in table]

    def near(self, word: int) -> tuple[np.ndarray, np.ndarray]:
        """All anchors within RADIUS + THRESHOLD, the nearest first, and their distances."""
        r = 0
        for b in range(LENGTH):
            if word >> b & 1:
                r ^= int(self.rem[b])
        return word ^ self.errors[r], self.weights[r]

    def of(self, fp: int, blocks: int) -> list[tuple[int, int]]:
        """(anchor, distance) of a fingerprint; the first is its home."""
        mask = (1 << LENGTH) - 1
        a, d = self.near(fp & mask)
        if blocks == 1:
            return list(zip(a.tolist(), d.tolist()))
        b, e = self.near(fp >> LENGTH & mask)
        both = d[:, None] + e[None, :]
        i, j = np.nonzero(both <= 2 * RADIUS + THRESHOLD)
        return list(zip((a[i] << LENGTH | b[j]).tolist(), both[i, j].tolist()))


_anchors: list[Anchors] = []


def anchors() -> Anchors:
    if not _anchors:
        _anchors.append(Anchors())
    return _anchors[0]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group) that join what the links (a, b) join."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def compare(homes: np.ndarray, guests: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between homes and guests."""
    links: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
    step = max(1, (1 << 21) // max(1, len(guests)))
    for start in range(0, len(homes), step):
        h = homes[start : start + step]
        i, j = np.nonzero(np.bitwise_count(h[:, None] ^ guests[None, :]) <= threshold)
        differ = h[i] != guests[j]
        links = _forest(np.concatenate([links[0], h[i][differ]]), np.concatenate([links[1], guests[j][differ]]))
    return links


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted by anchor, slot, guests last: homes are kept, guests come in batches."""
    key, homes = None, np.empty(0, np.int64)
    for batch in batches:
        d = batch.to_pandas()
        starts = np.flatnonzero(np.concatenate([[True], (d.anchor.values[1:] != d.anchor.values[:-1]) | (d.slot.values[1:] != d.slot.values[:-1])]))
        for lo, hi in zip(starts, np.append(starts[1:], len(d))):
            part = d.iloc[lo:hi]
            if (now := (part.anchor.iloc[0], part.slot.iloc[0])) != key:
                key, homes = now, np.empty(0, np.int64)
            guest = part.guest.values.astype(bool)
            homes = np.concatenate([homes, part.fp.values[~guest]])
            if len(homes) and guest.any():
                a, b = compare(homes, part.fp.values[guest])
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})


def links(fingerprints: DataFrame, blocks: int = 1, homes: int = HOMES) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that join all within THRESHOLD bits."""

    def spread(rows: dict) -> dict:
        table, fp, anchor, guest = anchors(), [], [], []
        for f in rows["fp"]:
            found = table.of(f, blocks)
            fp += [f] * (len(found) + 1)
            anchor += [found[0][0]] + [a for a, _ in found]
            guest += [False] + [True] * len(found)
        return {"fp": pa.array(fp, pa.int64()), "anchor": pa.array(anchor, pa.int64()), "guest": pa.array(guest, pa.bool_())}

    dealt = arrow_map(fingerprints.select("fp"), spread, "fp long, anchor long, guest boolean")
    slots = dealt.filter("not guest").groupBy("anchor").agg(F.ceil(F.count("*") / homes).cast("int").alias("slots"))
    dealt = dealt.join(slots, "anchor")  # an anchor without homes has nothing to compare
    dealt = dealt.withColumn("slot", F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), F.col("slots") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("slots")).cast("int")))))
    return dealt.select("anchor", "slot", "guest", "fp").repartition("anchor", "slot").sortWithinPartitions("anchor", "slot", "guest").mapInArrow(_groups, "a long, b long").distinct()


def fingerprint_roots(distinct: DataFrame, blocks: int | None = None) -> DataFrame:
    """(fp, root) of those of the distinct fingerprints `fp`, a stored table, that are within THRESHOLD bits of another."""
    if blocks is None:
        blocks = 1 if distinct.count() < TWO_BLOCKS else 2
    return components(links(distinct, blocks)).withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """rid, doc_id, fingerprint (16 hex digits), component_id, of every row of `docs`.

    Null and empty texts have fingerprint zero and are linked like any other. A component's id is
    the smallest doc_id that is not null in it; rows of null ids have a component too. Repeated
    rows count as rows. Only doc_id and text are read.
    """
    def one(rows: dict) -> dict:
        fp = np.array([fingerprint(t) for t in rows["text"]], np.uint64).view(np.int64)
        return {"doc_id": pa.array(rows["doc_id"], pa.int64()), "rid": pa.array(rows["rid"], pa.int64()), "fp": pa.array(fp)}

    prints = store(arrow_map(with_row_ids(docs, "doc_id", "text"), one, "doc_id long, rid long, fp long"), "prints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    joined = distinct.join(fingerprint_roots(distinct, blocks), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("rid", "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, one for each component: the smallest doc_id, then the first row."""
    docs = docs if is_scan(docs) else store(docs, "docs")
    found = simhash_components(docs)
    kept = found.groupBy("root").agg(F.min(F.struct(id_order().alias("o"), F.col("rid"))).alias("k")).select(F.col("k.rid").alias("rid"))
    return rows_of(docs, kept)
