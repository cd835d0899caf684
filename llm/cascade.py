"""Exact URL lists by a cascade of Bloom filters.

Level 1 holds the listed keys. Over the complete universe of keys of the corpus it accepts some
others; level 2 holds those, level 3 the listed keys that level 2 accepts wrongly, and so on until
a level accepts nothing wrongly. For every key of the universe the first level that rejects it
gives the exact answer, so URLs are judged where they stand, without a join. The first filter is
sized so that it lets through about as many keys as are listed; all levels together grow with the
list and the logarithm of the universe.

Filters are bit sets summed up by Spark; keys don't reach the driver. Filters of about a limit do:
where a list needs more, keys are dealt into shards by a hash, each shard has cascades of its own, and
the URLs are judged by one shard after the other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from llm.common import _unused, arrow_map, store

#: About the most bytes of the filters that are in use at a time; they travel with the plan.
LIMIT_BYTES = 64 << 20
#: Levels of a cascade. Each keeps half of the keys at most, so hardly any are left after these; they
#: are compared as they are.
DEPTH = 64
#: Bytes of a filter that a task puts together.
BLOCK = 1 << 16


@dataclass
class Level:
    number: int
    bits: bytes
    size: int
    hashes: int

    def accepts(self, key: Column) -> Column:
        bits = F.lit(bytearray(self.bits))  # once in the plan, whatever the number of hashes

        def is_set(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1

        return F.forall(F.array(*positions(key, self.number, self.hashes, self.size)), is_set)


def positions(key: Column, level: int, hashes: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * DEPTH + i), key), F.lit(size)) for i in range(hashes)]


def _hashes(rate: float) -> int:
    return max(1, round(-math.log2(rate)))


def _first_rate(n: int, every: int) -> float:
    """Of the keys that aren't listed, about as many pass the first level as are listed."""
    return min(0.5, math.sqrt(2) * n / max(n, every))


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter of the n keys in column `key` that accepts others at about `rate`."""
    hashes = _hashes(rate)
    size = max(64, math.ceil(n * hashes / math.log(2) / 64) * 64)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, hashes, size))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.pow(F.lit(2), F.pmod("at", F.lit(8))).cast("int")).alias("bits"))
    near = words.groupBy(F.floor(F.col("byte") / BLOCK).alias("block")).agg(
        F.collect_list(F.pmod("byte", F.lit(BLOCK)).cast("int")).alias("at"), F.collect_list("bits").alias("bits")
    )

    def pack(batch: dict) -> dict:
        packed = []
        for where, bits in zip(batch["at"], batch["bits"]):
            out = np.zeros(BLOCK, np.uint8)
            out[where] = bits
            packed.append(out.tobytes())
        return {"block": pa.array(batch["block"], pa.int64()), "bits": pa.array(packed, pa.binary())}

    out = bytearray(-(-size // 8 // BLOCK) * BLOCK)
    for r in arrow_map(near, pack, "block long, bits binary").collect():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = r["bits"]
    return Level(number, bytes(out[: size // 8]), size, hashes)


@dataclass
class Cascade:
    levels: list[Level]
    #: Keys that the last level accepts wrongly.
    rest: Sequence[str] = ()

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        if self.rest:
            out = out != key.isin(list(self.rest))
        for level in reversed(self.levels):
            out = F.when(level.accepts(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out


def build(listed: DataFrame, universe: DataFrame, depth: int = DEPTH) -> Cascade:
    """A cascade for the distinct, non-null keys of `listed` over those of `universe` (column `key`).

    Keys of the list that aren't in the universe may be in it all the same. An empty list gives a
    cascade that contains nothing. All filters come to the driver: see `shards_for`.
    """
    ours = store(listed.select("key").filter("key is not null").distinct(), "listed")
    n = ours.count()
    if not n:
        return Cascade([])
    every = universe.select("key").filter("key is not null")
    levels = [_level(ours, n, 1, _first_rate(n, every.count()))]
    wrong = store(every.filter(levels[0].accepts(F.col("key"))).join(ours, "key", "left_anti").distinct(), "wrong")
    inside, outside = ours, wrong  # what the next level must tell apart
    while (n := wrong.count()):
        if len(levels) == depth:
            return Cascade(levels, [r["key"] for r in wrong.collect()])
        level = _level(wrong, n, len(levels) + 1, 0.5)
        levels.append(level)
        if level.number % 2 == 0:
            outside = wrong
            wrong = inside = store(inside.filter(level.accepts(F.col("key"))), "wrong")
        else:
            inside = wrong
            wrong = outside = store(outside.filter(level.accepts(F.col("key"))), "wrong")
    return Cascade(levels)


def shards_for(n: int, every: int, limit: int = LIMIT_BYTES) -> int:
    """In how many shards n listed keys of a universe of `every` go, so that the filters of one take about `limit` bytes.

    The first level takes its number of hashes for each key, all others together about four more.
    """
    return max(1, math.ceil(n * (_hashes(_first_rate(n, every)) + 4) / math.log(2) / 8 / limit)) if n else 1


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: str = "url") -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def candidates(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All keys that a rule for this host and path can have, the longest first; of equals, the longer host.

    `labels` is the most labels in a rule's host, `lengths` the lengths of the rules' paths.
    """
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(sizes, lambda n: F.struct(-(F.length(s) + n), -F.length(s), F.concat(s, F.substring(path, F.lit(1), n)).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """All columns of `pages` and host, path, rule, verdict; columns with these names are replaced.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the
    rule's. The longest one that fits gives the verdict; without one the rule is null and the URL
    is allowed, as it is on no list. Null URLs and those without '://' have an empty host and path.

    `rules` is a list or a table of these three columns. Rules with a null, or with a verdict other
    than allow and block, are none; of equal ones for both verdicts, block holds. Where the filters
    need more than about `limit` bytes, every shard of keys costs one more reading of `pages`.
    """
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    rules = rules.select("verdict", "host", "path").filter("verdict in ('allow', 'block') and host is not null and path is not null")
    count, labels, lengths = rules.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    named = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*(F.col(f"`{c}`") for c in named), host_of().alias("host"), path_of().alias("path"))
    if not count:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), labels, sorted(lengths))
    universe = store(split.select(F.explode(keys).alias("key")).distinct(), "universe")
    listed = rules.select("verdict", F.concat("host", "path").alias("key"))
    shards = shards_for(count, universe.count(), limit)
    if shards > 1:
        listed = store(listed, "rules")
    hit = _unused("_hit", split.columns)
    kind = "array<struct<key:string,verdict:string>>"
    judged = split.withColumn(hit, F.array().cast(kind))
    for i in range(shards):
        mine = (lambda k: shard_of(k, shards) == i) if shards > 1 else (lambda k: F.lit(True))
        lists = {v: build(listed.filter((F.col("verdict") == v) & mine(F.col("key"))), universe.filter(mine(F.col("key")))) for v in ("allow", "block")}
        named_hit = lambda k: F.struct(k.alias("key"), F.when(lists["block"].contains(k), "block").when(lists["allow"].contains(k), "allow").alias("verdict"))
        found = F.filter(F.transform(F.filter(keys, mine), named_hit), lambda x: x["verdict"].isNotNull())
        judged = judged.withColumn(hit, F.concat(hit, F.slice(found, 1, 1).cast(kind)))
        if shards > 1:  # the filters of a shard go when its URLs are judged
            judged = store(judged, "judged")
    # the longest key of all shards; equal lengths: the longer host, as in `candidates`
    place = lambda x: F.array_position(keys, x["key"])
    best = F.array_min(F.transform(hit, lambda x: F.struct(place(x).alias("place"), x["key"].alias("key"), x["verdict"].alias("verdict")))) if shards > 1 else F.try_element_at(hit, F.lit(1))
    judged = judged.withColumn(hit, best)
    return judged.select(*(F.col(f"`{c}`") for c in named), "host", "path", F.col(f"{hit}.key").alias("rule"), F.coalesce(f"{hit}.verdict", F.lit("allow")).alias("verdict"))
