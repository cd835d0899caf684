"""Benchmark decontamination: test items found in documents within an edit budget.

Items and documents are compared as bytes of lower-cased text in which ASCII punctuation and white
space are single spaces. An item of m bytes may differ from a passage by `m // BYTES_PER_EDIT`
edits. It is cut into one piece more than its budget: by the pigeonhole principle a passage within
the budget holds one of the pieces unchanged. An automaton finds all pieces in a document, and
around each hit Myers' bit-parallel algorithm gives the least distance of the item to any passage.
Items of fewer than LEAST_BYTES bytes are one piece, without edits, and count where the piece stands
between word borders.

The items are a stated query set. They are read in blocks of bounded size, and each block is
searched for in all documents, so nothing but one block is ever on the driver or broadcast.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, store, with_row_ids

BYTES_PER_EDIT = 16
#: Shorter items are found unchanged and as whole words only.
LEAST_BYTES = 32
#: Bytes of items in a block.
BLOCK_BYTES = 16 << 20

_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """Lower case, ASCII punctuation and white space as single spaces, none at the ends."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE).split())


def budget(item: bytes) -> int:
    return len(item) // BYTES_PER_EDIT


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of budget + 1 pieces of nearly equal length."""
    n = budget(item) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: bytes) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def least_distance(item: bytes, passage: bytes, mask: dict[int, int] | None = None) -> int:
    """The smallest edit distance of `item` to any substring of `passage` (Myers, one word of len(item) bits)."""
    m, mask = len(item), mask or masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in passage:
        eq = mask.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return best


class Searcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.items = items
        found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, item) in enumerate(items):
            if len(item) < LEAST_BYTES:
                if item:
                    found[item].append((i, len(item)))
                continue
            for offset, piece in pieces(item):
                found[piece].append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece.decode("latin-1"), at)
        self.ready = bool(found)
        if found:
            self.automaton.make_automaton()
        self.masks: dict[int, dict[int, int]] = {}

    def search(self, text: bytes) -> dict[int, int]:
        """Item number to distance, of the items that occur within their budget."""
        out: dict[int, int] = {}
        stretches: dict[int, list[list[int]]] = defaultdict(list)
        for end, at in self.automaton.iter(text.decode("latin-1")) if self.ready else ():
            for i, done in at:
                item = self.items[i][1]
                if len(item) < LEAST_BYTES:
                    start = end + 1 - done
                    if (start == 0 or text[start - 1 : start] == b" ") and text[end + 1 : end + 2] in (b"", b" "):
                        out[i] = 0
                    continue
                e = budget(item)
                lo, hi = max(0, end + 1 - done - e), end + 1 - done + len(item) + e
                last = stretches[i][-1] if stretches[i] else None
                if last and lo <= last[1]:
                    last[0], last[1] = min(last[0], lo), max(last[1], hi)
                else:
                    stretches[i].append([lo, hi])
        for i, spans in stretches.items():
            item = self.items[i][1]
            mask = self.masks.setdefault(i, masks(item))
            least = min(least_distance(item, text[lo:hi], mask) for lo, hi in spans)
            if least <= budget(item):
                out[i] = least
        return out


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple[int, bytes]], bool]]:
    """Blocks of items and whether one follows; an empty block if there are no items."""
    ready, block, size = None, [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        item = plain(row["text"])
        block.append((row["item_id"], item))
        size += len(item)
        if size >= BLOCK_BYTES:
            if ready is not None:
                yield ready, True
            ready, block, size = block, [], 0
    if ready is None:
        yield block, False
    elif block:
        yield ready, True
        yield block, False
    else:
        yield ready, False


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """rid, doc_id, contaminated, n_items, item_ids, distances of every row of `docs`.

    item_ids are the items found, in ascending order (null ids first, one entry for each row of
    `items`), with their distances beside them. Null and empty texts and items match nothing.
    What one block of items hits is stored before the next one is read, so a benchmark of any size
    is never on the driver or the executors at once.
    """
    rows = with_row_ids(docs, "doc_id", "text")
    found = None
    for block, follows in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        searchers: list[Searcher] = []

        def one(batch: dict, shared=shared, searchers=searchers) -> dict:
            if not searchers:
                searchers.append(Searcher(shared.value))
            hits = []
            for text in batch["text"]:
                out = searchers[0].search(plain(text))
                hits.append([{"item_id": searchers[0].items[i][0], "distance": d} for i, d in out.items()])
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int64())]))
            return {"rid": pa.array(batch["rid"], pa.int64()), "doc_id": pa.array(batch["doc_id"], pa.int64()), "hits": pa.array(hits, kind)}

        part = arrow_map(rows, one, "rid long, doc_id long, hits array<struct<item_id:long,distance:long>>")
        if follows or found is not None:
            hit = store(part.filter("size(hits) > 0").select("rid", "hits"), "hits")
            shared.destroy()
            found = hit if found is None else found.union(hit)
    if found is not None:
        each = found.groupBy("rid").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        none = F.array().cast("array<struct<item_id:long,distance:long>>")
        part = rows.select("rid", "doc_id").join(each, "rid", "left").withColumn("hits", F.coalesce("hits", none))
    hits = F.sort_array("hits")
    return part.select("rid", "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_items"), hits["item_id"].alias("item_ids"), hits["distance"].alias("distances"))


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in which no item occurs; rows stay where they are."""
    for block, follows in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not searcher.search(plain(t)) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if follows:
            docs = store(docs, "clean")
            shared.destroy()
    return docs
