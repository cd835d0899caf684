"""Near copies by the Jaccard similarity of the texts' word shingles.

Candidates are the texts whose SimHash fingerprints, of the same shingles, are joined by links of
`simhash.THRESHOLD` bits or fewer: such a group is compared like a band. As texts of a similarity of
0.8 often differ in more bits than its anchors can cover, candidates also meet in the bands of a
MinHash signature: two texts of similarity s share one of BANDS bands of ROWS minima with
probability 1 - (1 - s**ROWS)**BANDS, which leaves out 3 in a million pairs at 0.8 and fewer above.
Bands with the same members count as one. Every link is checked on the whole shingle sets of both
texts, so no link is an estimate.

Texts of equal sets are combined first. The members of a band are compared in one task, which keeps
the sets of bounded slots of homes and reads all other members in turn; a member that is linked to a
group already is not compared with the rest of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, id_order, is_scan, rows_of, store, with_row_ids
from llm.components import components
from llm.simhash import fingerprint_of, fingerprint_roots
from llm.windows import BASE, mix

#: Words of a shingle, and the least similarity of near copies as a fraction.
WIDTH, LEAST = 5, (4, 5)
ROWS, BANDS = 5, 32
#: Members of a band that one task keeps.
HOMES = 4096
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (2, ROWS * BANDS, 1), np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n = max(1, len(h) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(width, len(h))):
        rolled = rolled * np.uint64(BASE) + h[i : i + n]
    return np.unique(mix(rolled))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the signature of a shingle set."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 1 << 13):
        least = np.minimum(least, (found[None, start : start + (1 << 13)] * (_RANDOM[0] | np.uint64(1)) + _RANDOM[1]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(BASE) + column)
    return keys.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = LEAST) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least the fraction."""
    part, whole = least
    if len(a) > len(b):
        a, b = b, a
    if len(a) * whole < part * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum()) if len(b) else 0
    return common * whole >= part * (len(a) + len(b) - common)


class Groups:
    """Members of a band, grouped by their links so far."""

    def __init__(self) -> None:
        self.groups: list[list[tuple[int, np.ndarray]]] = []

    def add(self, rid: int, found: np.ndarray, home: bool) -> list[int]:
        """The members, one for each group, that a text is linked to; these groups become one."""
        near, apart, hits = [], [], []
        for group in self.groups:
            hit = next((other for other, s in group if similar(found, s)), None)
            (apart if hit is None else near).append(group)
            hits += [] if hit is None else [hit]
        joined = [m for group in near for m in group] + ([(rid, found)] if home else [])
        self.groups = apart + ([joined] if joined else [])
        return hits


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted by key, slot, guests last."""
    now, groups = None, Groups()
    for batch in batches:
        a, b = [], []
        for key, slot, guest, rid, found in zip(*(batch.column(c).to_pylist() for c in ("key", "slot", "guest", "rid", "found"))):
            if (key, slot) != now:
                now, groups = (key, slot), Groups()
            hits = groups.add(rid, np.frombuffer(found, np.uint64), not guest)
            a += [rid] * len(hits)
            b += hits
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def jaccard_links(rows: DataFrame, keys: DataFrame, homes: int = HOMES) -> DataFrame:
    """Links (a, b) that join all rids of `keys` (rid, keys) whose texts in `rows` (rid, text) are similar."""
    each = keys.select("rid", F.explode("keys").alias("key"))
    size = each.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).filter("n > 1")
    once = store(size.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / homes).cast("int").alias("slots")), "bands")
    asked = each.join(once, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "slots")).alias("asked"))

    def spread(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("key", "slot", "guest", "rid", "found")}
        for rid, text, asked in zip(batch["rid"], batch["text"], batch["asked"]):
            found = shingles(text).tobytes()
            own = xxhash.xxh3_64_intdigest(str(rid))
            for key, slots in ((x["key"], x["slots"]) for x in asked):
                for slot in range(slots):
                    for name, x in zip(out, (key, slot, own % slots != slot, rid, found)):
                        out[name].append(x)
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        return {name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)}

    dealt = arrow_map(asked.join(rows.select("rid", "text"), "rid"), spread, "key long, slot int, guest boolean, rid long, found binary")
    return dealt.repartition("key", "slot").sortWithinPartitions("key", "slot", "guest").mapInArrow(_compare, "a long, b long")


def _with_groups(keys: DataFrame) -> DataFrame:
    """(rid, keys) of `keys` (rid, fp, keys), with a key more for the SimHash group of the text."""
    prints = store(keys.select("fp").distinct(), "fingerprints")
    group = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp"))
    return keys.join(fingerprint_roots(prints), "fp", "left").select("rid", F.array_append("keys", group).alias("keys"))


def first_of_similar(docs: DataFrame, homes: int = HOMES) -> DataFrame:
    """The rows of `docs`, all columns, one for each group of near copies: the smallest doc_id, then the first row.

    Groups are what links of similarity LEAST or more join. Texts without words are one group.
    """
    docs = docs if is_scan(docs) else store(docs, "docs")
    rows = with_row_ids(docs, "doc_id", "text")

    def one(batch: dict) -> dict:
        found = [shingles(t) for t in batch["text"]]
        digest = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
        keys = pa.array([bands(s) for s in found], pa.list_(pa.int64()))
        fp = pa.array(np.array([fingerprint_of(s) for s in found], np.uint64).view(np.int64))
        return {"doc_id": pa.array(batch["doc_id"], pa.int64()), "rid": pa.array(batch["rid"], pa.int64()), "digest": pa.array(digest), "fp": fp, "keys": keys}

    prints = store(arrow_map(rows, one, "doc_id long, rid long, digest long, fp long, keys array<long>"), "prints")
    firsts = store(prints.groupBy("digest").agg(F.min("rid").alias("first")), "sets")
    keys = prints.select("rid", "fp", "keys").join(firsts.select(F.col("first").alias("rid")), "rid", "left_semi")
    roots = components(jaccard_links(rows, _with_groups(keys), homes)).withColumnRenamed("node", "first")
    named = firsts.join(roots, "first", "left").select("digest", F.coalesce("root", "first").alias("root"))
    kept = prints.select("digest", "doc_id", "rid").join(named, "digest").groupBy("root").agg(F.min(F.struct(id_order().alias("o"), F.col("rid"))).alias("k"))
    return rows_of(docs, kept.select(F.col("k.rid").alias("rid")))
