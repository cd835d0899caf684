"""Byte-level BPE: encoding by rank tables in overlapping chunks, decoding by concatenated bytes.

A text longer than a chunk is cut into chunks that overlap. Each chunk is pre-tokenised by itself,
in any task. The pattern looks ahead, by one character and only after white space, so two scans that share a boundary agree from there on:
the scan of a chunk is taken up at the first boundary in the overlap that the scan before has as
well and that no white space precedes, and the stretches between those places are encoded, again in any task. Where two scans don't
meet inside the overlap, the rest of the text from the last certain boundary is one stretch. A text
of one chunk is a stretch as it is and moves nowhere.
"""

from __future__ import annotations

import base64

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from llm.common import arrow_map, store, with_row_ids

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Pre-tokens whose ids a task remembers.
REMEMBERED = 1 << 18


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The rank file of a tokenizer: a fixed vocabulary, read once by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder of single pre-tokens and decoder, with ids as decimal text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.merge = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token = {str(i): b for b, i in ranks.items()}
        self.known: dict[str, str] = {}

    def encode(self, text: str) -> list[str]:
        """Ids of the text: each match of the pattern is merged separately."""
        known, out = self.known, []
        for piece in self.pattern.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = ",".join(map(str, self.merge(piece)))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = ids
            out.append(ids)
        return ",".join(out).split(",") if out else []

    def decode(self, ids: list[str]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def boundaries(self, chunk: str, last: bool) -> list[int]:
        """Starts of matches in the chunk that a text may be cut at; the last ones may depend on what follows it.

        Not after white space: how a run of it is matched depends on the character that follows, which
        a stretch that ends there wouldn't have.
        """
        starts = [m.start() for m in self.pattern.finditer(chunk)]
        starts = starts if last else starts[:-2]
        return [s for s in starts if s == 0 or not WHITE.match(chunk, s - 1)]


WHITE = regex.compile(r"\s")


def _codec(shared) -> Codec:
    """The encoder of a broadcast vocabulary, which a worker keeps with it."""
    if not hasattr(shared, "codec"):
        shared.codec = Codec(*shared.value)
    return shared.codec


def split_chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(start, characters): chunks with the overlap that follows; a short rest joins the last one."""
    starts = [s for s in range(0, len(text), chunk) if s == 0 or len(text) - s > overlap]
    return [(s, text[s : s + chunk + overlap] if s != starts[-1] else text[s:]) for s in starts] or [(0, text)]


def _cut(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """rid, doc_id, k, last, start, chars, lead, tail of each chunk: the boundaries that lie in the
    overlaps with the chunk before and after, as positions in the text."""

    def cut(rows: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("rid", "doc_id", "k", "last", "start", "chars")}
        for rid, doc_id, text in zip(rows["rid"], rows["doc_id"], rows["text"]):
            parts = split_chunks(text, chunk, overlap)
            for k, (start, chars) in enumerate(parts):
                for name, value in zip(out, (rid, doc_id, k, k == len(parts) - 1, start, chars)):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string())
        return {name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds)}

    def scan(rows: dict) -> dict:
        codec, lead, tail = _codec(shared), [], []
        for start, last, chars in zip(rows["start"], rows["last"], rows["chars"]):
            at = codec.boundaries(chars, last)
            lead.append([start + b for b in at if b < overlap])
            tail.append([] if last else [start + b for b in at if b >= chunk])
        kind = pa.list_(pa.int64())
        return {n: pa.array(rows[n], t) for n, t in (("rid", pa.int64()), ("k", pa.int64()))} | {"lead": pa.array(lead, kind), "tail": pa.array(tail, kind)}

    chunks = store(arrow_map(texts, cut, "rid long, doc_id long, k long, last boolean, start long, chars string").repartition("rid", "k"), "chunks")
    return chunks, arrow_map(chunks.select("rid", "k", "last", "start", "chars"), scan, "rid long, k long, lead array<long>, tail array<long>")


def _stretches(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """rid, doc_id, part, text: consecutive stretches of each text that begin and end at boundaries."""
    chunks, scans = _cut(texts, shared, chunk, overlap)
    order = Window.partitionBy("rid").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("lead")))
    cuts = scans.select("rid", "k", F.when(F.col("k") == 0, 0).otherwise(met).alias("cut"))
    cuts = cuts.withColumn("certain", F.min(F.col("cut").isNotNull()).over(order))
    cuts = cuts.withColumn("cut", F.when(F.col("certain"), F.col("cut")))
    first = F.max(F.when(F.col("certain"), F.col("k"))).over(order)
    ends = cuts.withColumn("part", first).withColumn("next", F.lead("cut").over(order)).withColumn("from", F.max("cut").over(order))
    # up to the next cut; an uncertain chunk adds what the one before has not
    joined = chunks.join(ends.select("rid", "k", "cut", "part", "next", "from", "certain"), ["rid", "k"])
    begin = F.when(F.col("certain"), F.col("cut")).otherwise(F.col("start") + overlap)
    has = F.col("start") + F.length("chars")
    end = F.when(F.col("next").isNotNull(), F.col("next")).otherwise(has)
    # where the next chunk is uncertain, this one gives all it has, overlap included
    text = F.substring("chars", (begin - F.col("start") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    piece = joined.select("rid", "doc_id", "part", "k", text.alias("text"))
    joined_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "")
    return piece.groupBy("rid", "part").agg(F.first("doc_id").alias("doc_id"), joined_text.alias("text"))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """rid, doc_id, n_tokens, ids (decimal, joined by commas), decoded (bytes) of every row of `docs`.

    Null and empty texts have no tokens. Only doc_id and text are read; repeated rows are rows
    like others. `decoded` comes from the ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def encode(rows: dict) -> dict:
        codec = _codec(shared)
        ids = [codec.encode(t or "") for t in rows["text"]]
        return {
            "rid": pa.array(rows["rid"], pa.int64()), "part": pa.array(rows["part"], pa.int64()), "doc_id": pa.array(rows["doc_id"], pa.int64()),
            "n_tokens": pa.array([len(i) for i in ids], pa.int64()), "ids": pa.array([",".join(i) for i in ids], pa.string()),
            "decoded": pa.array([codec.decode(i) for i in ids], pa.binary()),
        }

    schema = "rid long, part long, doc_id long, n_tokens long, ids string, decoded binary"
    rows = with_row_ids(docs, "doc_id", "text")
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = arrow_map(rows.filter(~long).withColumn("part", F.lit(0).cast("long")), encode, schema).drop("part")
    parts = arrow_map(_stretches(rows.filter(long), shared, chunk, overlap).select("rid", "part", "doc_id", "text").repartition("rid", "part"), encode, schema)
    ordered = F.array_sort(F.collect_list(F.struct("part", "ids", "decoded")))
    whole = parts.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), ordered.alias("p"))
    ids = F.array_join(F.filter(F.transform("p", lambda x: x["ids"]), lambda i: i != ""), ",")
    decoded = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["decoded"]))
    return short.unionByName(whole.select("rid", "doc_id", "n_tokens", ids.alias("ids"), decoded.alias("decoded")))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
