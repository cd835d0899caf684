"""What each of several filters removes, by the order in which they are applied.

A document's failures are a mask of bits. Four come from its own text; the last, 'identical to an
earlier document', needs the whole table: texts are dealt by ranges of their prefixes, long enough
in crowded places and short elsewhere, and each range inserts its whole texts into compressed
tries, one for each prefix. A terminal holds the smallest id of its text. A copy shows as one
when it meets a smaller id, or is met by one; what the terminals still hold at the end of a prefix
is no copy. Texts that a task has met before with a smaller id are known as copies there and
aren't dealt at all. Masks are then counted for each part of the table, and all orders of the
filters are read off the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import store

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
UPPER, MARKS, INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Bytes of the prefixes that may deal a text; bytes of texts for a task; bytes of texts that a task remembers.
DEPTHS = (8, 32, 128, 512, 2048)
TASK_BYTES = 512 << 20
SEEN_BYTES = 16 << 20
Order = tuple[bool, int]


def own_failures(text: bytes) -> int:
    """Bits A to D: under 100 words; too few distinct words; too many capitals; marks."""
    words, size = text.split(), len(text)
    short = len(words) < 100
    dull = 100 * len(set(words)) < 80 * len(words)
    loud = 100 * (size - len(text.translate(None, UPPER))) > 10 * len(text.translate(None, INNER))
    marked = len(text.translate(None, MARKS)) < size
    return short | dull << 1 | loud << 2 | marked << 3


class Trie:
    """A compressed radix trie of whole texts; its nodes are the tries below them."""

    __slots__ = ("edge", "next", "least", "parts")

    def __init__(self, edge: bytes = b"") -> None:
        self.edge = edge
        self.next: dict[int, Trie] = {}
        self.least: Order | None = None
        self.parts: Counter = Counter()

    def terminal(self, text: bytes) -> Trie:
        """The node at which the text ends, made if it isn't there."""
        node, at = self, 0
        while at < len(text):
            child = node.next.get(text[at])
            if child is None:
                child = node.next[text[at]] = Trie(text[at:])
            elif not text.startswith(child.edge, at):
                keep = _common(child.edge, text, at)
                middle = node.next[text[at]] = Trie(child.edge[:keep])
                child.edge = child.edge[keep:]
                middle.next[child.edge[0]] = child
                child = middle
            node, at = child, at + len(child.edge)
        return node

    def add(self, text: bytes, order: Order, row: tuple) -> list[tuple[tuple, int]]:
        """Insert a text; return the rows that are shown to be copies, with their number."""
        node = self.terminal(text)
        if node.least is not None and order > node.least:
            return [(row, 1)]
        copies = [] if node.least is None or order == node.least else list(node.parts.items())
        if copies:
            node.parts = Counter()
        node.least = order
        node.parts[row] += 1
        return copies

    def first(self) -> Iterator[tuple[tuple, int]]:
        """The rows of the smallest id of each text, with their number."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield from node.parts.items()
            stack.extend(node.next.values())


def _common(edge: bytes, text: bytes, at: int) -> int:
    """Length of the longest common prefix of an edge and a text from `at` on."""
    lo, hi = 0, min(len(edge), len(text) - at)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if text.startswith(edge[lo:middle], at + lo):
            lo = middle
        else:
            hi = middle - 1
    return lo


def _crowded(texts: DataFrame, parts: int) -> tuple[frozenset[int], int]:
    """Hashes of the prefixes that more than an eighth of a task's bytes share, and the number of tasks.

    At most 8 prefixes of each depth for a task, whatever the texts are.
    """
    size = F.octet_length("text")
    prefixes = F.array(*(F.struct(F.lit(d).alias("depth"), F.xxhash64(F.substring("text", 1, d)).alias("hash")) for d in DEPTHS))
    count = texts.select(size.cast("long").alias("bytes"), F.explode(prefixes).alias("p")).groupBy("p").agg(F.sum("bytes").alias("bytes"))
    count = store(count, "prefixes")
    total = count.filter(F.col("p.depth") == DEPTHS[0]).agg(F.sum("bytes")).first()[0] or 0
    parts = max(parts, -(-total // TASK_BYTES))
    rows = count.filter(F.col("bytes") * 8 * parts > total).select("p.depth", "p.hash").collect()
    return frozenset(hash((r.depth, r.hash)) for r in rows), parts


def _depth(text: bytes, crowded: frozenset[int]) -> tuple[int, int]:
    """Bytes of the prefix that deals a text, and a hash of the rest if the longest prefixes are crowded too."""
    for d in DEPTHS:
        h = xxhash.xxh64_intdigest(text[:d], 42)
        if hash((d, h - (h >> 63 << 64))) not in crowded:
            return d, 0
    return DEPTHS[-1], xxhash.xxh64_intdigest(text, 1) >> 1


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: how many rows of `docs` with this id and part fail the filters of the mask.

    A null text counts as empty, a null part as the empty string. A null id is larger than all
    others; rows of equal text and equal smallest id are all no copies. Only doc_id, text and
    `part` are read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
    )
    crowded, parts = _crowded(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shared = spark.sparkContext.broadcast(crowded)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = {}, 0
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("mask", "text", "depth", "rest")}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                order, known = (doc_id is None, doc_id or 0), seen.get(text)
                if known is None:
                    known = seen[text] = [order, own_failures(text), False]
                    held += len(text) + 100
                else:
                    known[2] = True
                copy = known[0] < order
                known[0] = min(known[0], order)
                depth, rest = (0, 0) if copy else _depth(text, shared.value)
                for name, value in zip(out, (known[1] | COPY * copy, None if copy else text, depth, rest)):
                    out[name].append(value)
                if held > SEEN_BYTES:
                    seen = {t: k for t, k in seen.items() if k[2]}
                    held = sum(len(t) + 100 for t in seen)
                    if 2 * held > SEEN_BYTES:
                        seen, held = {}, 0
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "part": batch.column("part"),
                "mask": pa.array(out["mask"], pa.int32()),
                "text": pa.array(out["text"], pa.binary()),
                "depth": pa.array(out["depth"], pa.int32()),
                "rest": pa.array(out["rest"], pa.int64()),
            })

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie = None, Trie()
        for batch in batches:
            out = []
            for doc_id, part, mask, text, depth, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "text", "depth", "rest"))):
                if (text[:depth], rest) != now:
                    out += [(*row, n) for row, n in trie.first()]
                    now, trie = (text[:depth], rest), Trie()
                out += [(i, p, m | COPY, n) for (i, p, m), n in trie.add(text, (doc_id is None, doc_id or 0), (doc_id, part, mask))]
            yield _rows(out)
        yield _rows([(*row, n) for row, n in trie.first()])

    one = store(rows.mapInArrow(own, "doc_id long, part string, mask int, text binary, depth int, rest long"), "masks")
    prefix = F.expr("substring(text, 1, depth)")
    dealt = one.filter("text is not null").withColumn("prefix", prefix).repartitionByRange(parts, "prefix", "rest").sortWithinPartitions("prefix", "rest").drop("prefix")
    found = dealt.mapInArrow(tries, "doc_id long, part string, mask int, n long")
    copies = one.filter("text is null").select("doc_id", "part", "mask", F.lit(1).cast("long").alias("n"))
    return found.unionByName(copies).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, parts, masks, n = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "part": pa.array(parts, pa.string()), "mask": pa.array(masks, pa.int32()), "n": pa.array(n, pa.int64())})


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """(order, step, the counts) of every order and step; n, good and toxic are indexed by mask."""
    masks = np.arange(len(n))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows, total = [], Counter()
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = (masks & bit[f]) > 0, (masks & before) > 0
            here = fails & ~gone
            before |= bit[f]
            removed = int(n[here].sum())
            total[f] += removed
            rows.append(("".join(order), step, int(n[(masks & before) == 0].sum()), removed, int(n[fails & gone].sum()), int(n[bit[f]]), int(good[here].sum()), int(toxic[here].sum())))
    for row in rows:
        yield *row, total[row[0][row[1] - 1]]


def interactions(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, for each part of `failed` (from `failures`), order and step.

    A document is good or toxic if any row of `labels` (doc_id, quality, toxic) with its id says 1.
    """
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counts = (
        failed.join(said, "doc_id", "left").groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), *(F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")))
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                by = {c: np.zeros(1 << len(FILTERS), np.int64) for c in ("n", "good", "toxic")}
                for m in masks:
                    for c, x in by.items():
                        x[m["mask"]] = m[c]
                order, step, *values = zip(*_orders(**by))
                out = {"part": pa.array([part] * len(order)), "filter_order": pa.array(order), "step": pa.array(step, pa.int32())}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, values)})

    return counts.mapInArrow(expand, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
