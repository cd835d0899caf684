"""Set-similarity join of documents by prefixes under several global token orders.

A document's set has its distinct word shingles as 64-bit hashes. Of two sets with a Jaccard
similarity of at least t, each has so many tokens in common with the other that, whatever order all
tokens are put in, the smallest common token is among the first n - ceil(t * n) + 1 tokens of
either. So candidates must share a prefix token under every order. Three orders are used: rarest
first, by a table of counters over all sets, in which a token that nothing else is
counted with is nobody else's; and two by hashes.

Equal sets are one node. Documents that share a prefix token of the first order and whose set sizes
follow each other without a step too large for two similar sets are a group; groups of the same
members are one. Of the later orders, similar sets share not only one prefix token but a number of
them, which their sizes tell. A group's leader is the member whose tokens most others have. Pairs
of a leader and a member are filtered by the other two orders, then verified on the whole sets: a
row for each membership, so a large group of near copies costs what its rows cost. Only members
that this leaves outside their leader's component are compared with the rest of their group, again
through the filters first; large groups of these are dealt by the tokens of the second order, and
homes of a bounded number per task. A member that is linked to a component isn't compared with it
again. No link between components is lost, and none is taken on trust.

Prefix tokens are shuffled once, and texts and later prefixes only of documents that a bitmap of the
wanted ones lets through: what moves is in proportion to the input, also where nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from llm.common import id_order, store, with_row_ids
from llm.components import components
from llm.jaccard import similar
from llm.windows import BASE, mix

WIDTH, LEAST = 3, (9, 10)
#: Counters of the table of token frequencies: 32 for a document, between these powers of two. At 4
#: bytes each the driver and the tasks hold 64 MB of them at most.
BITS = (16, 24)
CHUNK = 1 << 12
#: Prefix tokens of the members that one task keeps; larger groups are dealt by their tokens of the second order.
HOMES = 1 << 18
#: Bits of the map of wanted documents, between these powers of two, so 16 MB at most; a chunk of it has MAP_CHUNK bytes.
MAP_BITS, MAP_CHUNK = (15, 27), 1 << 12
SEEDS = (np.uint64(0x9E6C63D0676A9A99), np.uint64(0xB5297A4D3F84D5B5))
ROWS = 500


def prefix_length(n: int, least: tuple[int, int] = LEAST) -> int:
    part, whole = least
    return n - -(-part * n // whole) + 1 if n else 0


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _first(key: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Which tokens are in the prefix under the order of the key; all of those that tie with its last."""
    n = prefix_length(len(key), least)
    return key <= np.partition(key, n - 1)[n - 1] if n else np.zeros(0, bool)


def by_hash(tokens: np.ndarray, seed: np.uint64, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The prefix under a hashed order, as the low 32 bits of its tokens."""
    return tokens[_first(mix(tokens ^ seed), least)].astype(np.uint32).view(np.int32)


def by_rarity(tokens: np.ndarray, counts: np.ndarray, bits: int, least: tuple[int, int] = LEAST) -> np.ndarray:
    """The prefix under the order of counts, without tokens that are nobody else's."""
    n = counts[_slots(tokens, bits)]
    key = (n.astype(np.uint64) << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))
    return tokens[_first(key, least) & (n > 1)].view(np.int64)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; each distinct word is hashed once.

    Words are lower-cased after the split, which copies them: `ascii_lower` misreads a cast slice.
    """
    parts = pc.ascii_split_whitespace(texts.fill_null(b"").cast(pa.large_binary()).view(pa.large_string()))
    flat = parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    offsets = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    words = flat.filter(some).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in pc.ascii_lower(words.dictionary)), np.uint64, len(words.dictionary))
    h = mix(known)[words.indices.to_numpy()] if len(known) else np.empty(0, np.uint64)
    rolled = np.zeros(len(h), np.uint64)
    for i in range(WIDTH):
        rolled[: len(h) - i] = rolled[: len(h) - i] * np.uint64(BASE) + h[i:]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if 0 < hi - lo < WIDTH:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[lo:hi].tobytes())], np.uint64))
            continue
        found = np.sort(rolled[lo : hi - WIDTH + 1]) if hi > lo else h[:0]
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        out.append(found[new])
    return out


def node_of(found: np.ndarray) -> int:
    """The first eight bytes of the digest of a set, as a signed number."""
    return int.from_bytes(xxhash.xxh3_128_digest(found.tobytes())[:8], "big", signed=True)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            piece = batch.slice(lo, ROWS)
            yield piece, _sets(piece.column("text"))


def _prints(rows: DataFrame, bits: int) -> DataFrame:
    """A row for each document (rid, doc_id, n, digest), and for each task its counts in chunks (chunk, counts), compressed.

    A task counts up to 255, which keeps its chunks small; sums of that order tokens just as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for piece, sets in _texts(batches):
            np.add.at(counts, _slots(np.concatenate(sets), bits), np.uint32(1))
            empty = [None] * len(sets)
            yield pa.RecordBatch.from_arrays([piece.column("rid"), piece.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())], SCHEMA)
        chunks = [(i, pa.compress(c.tobytes(), "zstd", asbytes=True)) for i, c in enumerate(np.minimum(counts, 255).astype(np.uint8).reshape(-1, CHUNK)) if c.any()]
        for lo in range(0, len(chunks), ROWS):
            some = chunks[lo : lo + ROWS]
            none = [None] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64())] * 3 + [pa.array(none, pa.binary()), pa.array([i for i, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], SCHEMA)

    return rows.mapInArrow(run, "rid long, doc_id long, n long, digest binary, chunk int, counts binary")


SCHEMA = ["rid", "doc_id", "n", "digest", "chunk", "counts"]


def _frequencies(marks: DataFrame, bits: int) -> np.ndarray:
    """The counts of all tasks, added up chunk by chunk; what one task reads is added up before the shuffle."""

    def added(given: type, made: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                    counts = pa.decompress(counts, given().itemsize * CHUNK, "zstd")
                    total[chunk] = total.get(chunk, np.uint32(0)) + np.frombuffer(counts, given).astype(np.uint32)
            found = (np.minimum(x, np.iinfo(made).max).astype(made) for x in total.values())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in found], pa.binary())})

        return run

    out = np.zeros(1 << bits, np.uint32).reshape(-1, CHUNK)
    chunks = marks.filter("chunk is not null").select("chunk", "counts").mapInArrow(added(np.uint8, np.uint16), "chunk int, counts binary")
    for row in chunks.repartition("chunk").mapInArrow(added(np.uint16, np.uint32), "chunk int, counts binary").collect():
        out[row.chunk] = np.frombuffer(pa.decompress(row.counts, 4 * CHUNK, "zstd"), np.uint32)
    return out.ravel()


def _prefixes(rows: DataFrame, counts: np.ndarray, bits: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, sets in _texts(batches):
            columns = {"rid": piece.column("rid"), "node": pa.array([node_of(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64())}
            columns["first"] = _lists([by_rarity(s, shared.value, bits) for s in sets], pa.int64())
            for name, seed in zip(("second", "third"), SEEDS):
                columns[name] = _lists([by_hash(s, seed) for s in sets], pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, "rid long, node long, n long, first array<long>, second array<int>, third array<int>")


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays), kind))


class Member:
    """A document in a group: its length, and its prefixes under the later orders or its set."""

    __slots__ = ("rid", "part", "n", "second", "third", "tokens", "kept")

    def __init__(self, row: dict) -> None:
        self.rid, self.part, self.n, self.kept = row["rid"], row["part"], row["n"], False
        self.second = row.get("second") and frozenset(row["second"])
        self.third = row.get("third") and frozenset(row["third"])
        self.tokens = row.get("found")

    def may_match(self, other: Member) -> bool:
        part, whole = LEAST
        if min(self.n, other.n) * whole < part * max(self.n, other.n):
            return False
        return self.shares(self.second, other, other.second) and self.shares(self.third, other, other.third)

    def shares(self, own: frozenset, other: Member, others: frozenset) -> bool:
        """Whether the prefixes of an order share what two similar sets share at least.

        Of the prefix that ends first, tokens that the other one lacks are not in the other's set at all.
        """
        part, whole = LEAST
        shared = len(own & others)
        most = max(self.n - len(own), other.n - len(others)) + shared
        return shared > 0 and most * (part + whole) >= part * (self.n + other.n)

    def matches(self, other: Member) -> bool:
        return similar(self.tokens, other.tokens, LEAST)


def _grouped(rows: DataFrame, columns: tuple[str, ...], start: Callable, each: Callable, schema: str) -> DataFrame:
    """Groups (key, slot) of members, homes first: `start` makes a group's state, `each` reads a member into it and yields rows.

    Of members with a text, the set is made here: a text is smaller than its set.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    whole = "text" in columns
    plain = [c for c in columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for piece, sets in _texts(batches) if whole else ((batch, None) for batch in batches):
            out = []
            for i, row in enumerate(piece.select(plain).to_pylist()):
                if (row["key"], row["slot"]) != now:
                    now, state = (row["key"], row["slot"]), start()
                if sets:
                    row["found"] = sets[i]
                out += each(state, Member(row), row)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * len(names), names)

    return rows.select(*columns).repartition("key", "slot").sortWithinPartitions("key", "slot", F.desc("home")).mapInArrow(run, schema)


def _led(test: str) -> tuple[Callable, Callable]:
    """The leader stands first; members that pass the test with it."""

    def each(state: list, member: Member, row: dict) -> Iterator[tuple]:
        if row["home"]:
            state.append(member)
        elif getattr(member, test)(state[0]):
            yield state[0].rid, member.rid

    return list, each


def _possible(state: list, member: Member, row: dict) -> Iterator[tuple]:
    """Members, once each, that may match one of another component."""
    for other in state:
        if member.part != other.part and not (member.kept and other.kept) and member.may_match(other):
            for m in (member, other):
                if not m.kept:
                    m.kept = True
                    yield row["key"], row["slot"], m.rid
    if row["home"]:
        state.append(member)


def _linked(state: dict, member: Member, row: dict) -> Iterator[tuple]:
    """Links that join components."""
    homes, joined = state.setdefault("homes", []), state.setdefault("joined", {})

    def root(part: int) -> int:
        while part in joined:
            part = joined[part]
        return part

    for other in homes:
        a, b = root(member.part), root(other.part)
        if a != b and member.matches(other):
            joined[max(a, b)] = min(a, b)
            yield member.rid, other.rid
    if row["home"]:
        homes.append(member)


def _among(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The `rows` whose rid is in `wanted`, a stored table, and a few others, so that a join by rid moves few others.

    A bitmap with a place for each hashed rid goes to the tasks.
    """
    least, most = MAP_BITS
    bits = min(max((64 * wanted.count()).bit_length(), least), most)

    def slot(rid: np.ndarray) -> np.ndarray:
        return (mix(rid.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)

    def chunks(given: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                if given == "rid":
                    at = np.unique(slot(batch.column("rid").to_numpy()))
                    parts = np.split(at, np.flatnonzero(np.diff(at // (8 * MAP_CHUNK))) + 1) if len(at) else []
                    new = ((int(p[0]) // (8 * MAP_CHUNK), np.packbits(np.bincount(p % (8 * MAP_CHUNK), minlength=8 * MAP_CHUNK).astype(bool))) for p in parts)
                else:
                    new = zip(batch.column("chunk").to_pylist(), (np.frombuffer(x, np.uint8) for x in batch.column("marks").to_pylist()))
                for chunk, marks in new:
                    found[chunk] = found[chunk] | marks if chunk in found else marks
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(list(found), pa.int32()), "marks": pa.array([x.tobytes() for x in found.values()], pa.binary())})

        return run

    bitmap = np.zeros((-(-(1 << bits) // (8 * MAP_CHUNK)), MAP_CHUNK), np.uint8)
    schema = "chunk int, marks binary"
    for row in wanted.select("rid").mapInArrow(chunks("rid"), schema).repartition("chunk").mapInArrow(chunks("chunk"), schema).collect():
        bitmap[row.chunk] = np.frombuffer(row.marks, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.ravel())

    @F.pandas_udf("boolean")
    def marked(rid: pd.Series) -> pd.Series:
        at = slot(rid.to_numpy())
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return rows.filter(marked("rid"))


def _with_texts(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """`asked`, a stored table, with the documents' texts."""
    return asked.join(_among(rows.select("rid", "text"), asked), "rid")


def _members(prefixes: DataFrame) -> DataFrame:
    """Groups (x, y, size) of different sets (node, n) that share a token of the first order, two sets at least.

    In the order of n, a group ends before a set that is too large to be similar to the one before it.
    All of a token is in one partition from the start; x and y are of the members, so that groups of
    the same members are one.
    """
    part, whole = LEAST
    each = prefixes.select("node", "n", F.explode("first").alias("token")).repartition("token")
    order = Window.partitionBy("token").orderBy("n", "node")
    once = each.withColumn("before", F.lag("node").over(order)).filter("before is null or before <> node").drop("before")
    near = once.withColumn("below", F.lag("n").over(order)).withColumn("above", F.lead("n").over(order))
    first = F.col("below").isNull() | (part * F.col("n") > whole * F.col("below"))
    last = F.col("above").isNull() | (part * F.col("above") > whole * F.col("n"))
    some = near.withColumn("first", first).withColumn("last", last).filter("not (first and last)")
    group = Window.partitionBy("token", "run")
    known = some.withColumn("run", F.sum(F.col("first").cast("long")).over(order)).select(
        F.bit_xor(F.xxhash64("node")).over(group).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).over(group).alias("y"), F.count("*").over(group).alias("size"), "node", "n"
    )
    return known.distinct()


def similar_links(rows: DataFrame, prefixes: DataFrame, firsts: DataFrame, homes: int = HOMES) -> DataFrame:
    """Links (a, b) that join what all pairs of similar documents join.

    `rows` are (rid, text), `prefixes` (rid, node, n, first, second, third) of each document, `firsts`
    (node, first) the one document that stands for each set.
    """
    part, whole = LEAST
    member = store(_members(prefixes).join(firsts.select("node", F.col("first").alias("rid")), "node").drop("node"), "members")
    group = ["x", "y", "size"]
    shared = member.groupBy("rid").agg(F.sum("size").alias("shared"))
    lead = member.join(shared, "rid").groupBy(group).agg(F.max(F.struct("shared", F.negate("rid").alias("r"), "n")).alias("l")).select(*group, F.negate("l.r").alias("key"), F.col("l.n").alias("lead_n"))
    member = store(member.join(lead, group), "members")

    # leaders with their members
    payload = prefixes.select("rid", "second", "third")
    zero = F.lit(0).cast("long")
    alike = member.filter((F.col("key") != F.col("rid")) & (whole * F.least("n", "lead_n") >= part * F.greatest("n", "lead_n")))
    led = alike.select("key", "rid", "n", F.lit(False).alias("home")).union(alike.select("key", "key", "lead_n", F.lit(True))).distinct()
    led = store(led.withColumn("slot", zero).withColumn("part", zero), "led")
    names = ("key", "slot", "home", "rid", "part", "n")
    pairs = store(_grouped(led.join(_among(payload, led), "rid"), (*names, "second", "third"), *_led("may_match"), "a long, b long"), "pairs")
    sides = pairs.select(F.col("a").alias("key"), F.col("b").alias("rid"), F.lit(False).alias("home"))
    sides = sides.union(pairs.select("a", "a", F.lit(True)).distinct())
    sides = store(sides.withColumn("slot", zero).withColumn("part", zero).withColumn("n", zero), "sides")
    first = store(_grouped(_with_texts(sides, rows), (*names, "text"), *_led("matches"), "a long, b long"), "verified")

    # what is outside its leader's component, with all others of its group
    roots = components(first)
    named = member.filter("size > 2").join(roots.select(F.col("node").alias("rid"), F.col("root")), "rid", "left").select(*group, "key", "rid", "n", F.coalesce("root", "rid").alias("part"))
    own = named.filter("key = rid").select(*group, F.col("part").alias("lead"))
    outside = named.filter("key <> rid").join(own, group).select(*group, "key", "rid", "n", "part", (F.col("part") != F.col("lead")).alias("home"))
    mixed = outside.groupBy(group).agg(F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most").select(group)
    left = store(outside.join(mixed, group, "left_semi").groupBy("key", "rid", "n", "part").agg(F.max("home").alias("home")), "outside")
    left = left.withColumn("weight", F.when(F.col("home"), F.expr(f"n - ceil({part} * n / {whole}) + 1")).otherwise(0))
    left = store(left.join(left.groupBy("key").agg(F.sum("weight").alias("homes")).filter("homes > 0"), "key"), "outside")
    left = store(left.join(_among(payload, left), "rid"), "outside")
    small = left.filter(F.col("homes") <= homes).withColumn("slot", zero)
    by_token = left.filter(F.col("homes") > homes).withColumn("token", F.explode("second"))
    crowd = by_token.groupBy("key", "token").agg(F.sum("weight").alias("homes"), F.min("part").alias("least"), F.max("part").alias("most")).filter("least < most")
    slots = F.greatest(F.ceil(F.col("homes") / homes), F.lit(1)).cast("int")
    dealt = by_token.drop("homes").join(crowd.select("key", "token", "homes"), ["key", "token"]).withColumn("s", F.explode(F.sequence(F.lit(0), slots - 1)))
    dealt = dealt.withColumn("home", F.col("home") & (F.pmod(F.xxhash64("rid"), slots) == F.col("s"))).withColumn("slot", F.xxhash64("token", "s"))
    asked = small.select(*names, "second", "third").unionByName(dealt.select(*names, "second", "third"))
    asked = store(asked, "asked")
    may = _grouped(asked, (*names, "second", "third"), list, _possible, "key long, slot long, rid long")
    again = store(asked.select(*names).join(may, ["key", "slot", "rid"]), "possible")
    second = _grouped(_with_texts(again, rows), (*names, "text"), dict, _linked, "a long, b long")
    return store(first.unionByName(store(second, "joined")), "similar")


def similar_sets(docs: DataFrame, homes: int = HOMES, bits: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of `docs`.

    A-Z count as a-z. A text with fewer words than a shingle is one shingle; one without words, or
    null, has none and is linked with nothing. component_id is the smallest doc_id that links
    reach, null if all are null; rows with equal sets are linked, also rows that are repeated.
    Only doc_id and text are read.
    """
    rows = with_row_ids(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    bits = bits or min(max((32 * rows.count()).bit_length(), BITS[0]), BITS[1])
    marks = store(_prints(rows, bits), "prints")
    prints = marks.filter("chunk is null").select("rid", "doc_id", "n", "digest")
    firsts = store(prints.filter("n > 0").groupBy("digest").agg(F.min("rid").alias("first")), "sets")
    prefixes = store(_prefixes(rows, _frequencies(marks, bits), bits), "prefixes")
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    roots = components(similar_links(rows, prefixes, firsts.select(node.alias("node"), "first"), homes)).withColumnRenamed("node", "first")
    named = firsts.join(roots, "first", "left").select("digest", F.coalesce("root", "first").alias("root"))
    # a text without words is a component of its own
    found = store(prints.join(named, "digest", "left").select("doc_id", "n", F.coalesce("root", -F.col("rid") - 1).alias("root")), "roots")
    least = found.filter("root >= 0").groupBy("root").agg(F.min(id_order()).alias("least")).select("root", F.col("least.id").alias("least"))
    out = found.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root") >= 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
