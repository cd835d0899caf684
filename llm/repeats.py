"""Windows of documents that recur: phrases by anchor, then single windows where phrases differ.

Shared by the suffix-array and the Lempel-Ziv operator. Rows of phrases are (rid, ord, lo, hi,
anchor, phrase): windows lo..hi of the document share the anchor, and `phrase` is the hash of all
their text. `ord` orders documents. A rule says when a window that occurs several times is covered:
`anywhere`, if it occurs at another place at all, or `before`, if it occurs in a document of a
smaller ord.

Rows of equal phrase share their fate, so one row per phrase is looked at closer, and only under
anchors with several phrases. Its windows' hashes go to the other phrases of the anchor as one
array; anchors with very many phrases are dealt by window instead.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm.common import arrow_map, store
from llm.windows import Block, blocks

Units = Callable[[str], np.ndarray]
#: Phrases of one anchor that are compared in one task.
PHRASES = 10_000


def phrases(rows: DataFrame, units: Units, k: int, w: int) -> DataFrame:
    """Phrases of the documents `rows` (rid, ord, text)."""

    def cut(batch: dict) -> dict:
        found: dict[str, list] = {c: [np.empty(0, np.int64)] for c in ("rid", "ord", "lo", "hi", "anchor", "phrase")}
        for rid, order, text in zip(batch["rid"], batch["ord"], batch["text"]):
            for block in blocks(units(text), k, w) if text else ():
                p = block.phrases()
                found["rid"].append(np.full(len(p["lo"]), rid))
                found["ord"].append(np.full(len(p["lo"]), order))
                for name, values in p.items():
                    found[name].append(values)
        out = {name: np.concatenate(v) for name, v in found.items()}
        return out | {name: out[name].astype(np.int32) for name in ("lo", "hi")}

    return arrow_map(rows, cut, "rid long, ord long, lo int, hi int, anchor long, phrase long")


def covered_windows(found: DataFrame, rows: DataFrame, units: Units, m: int, rule: str, most: int = PHRASES) -> DataFrame:
    """(rid, spans, points): the covered windows of each document, as runs (lo, hi) and as single ones.

    `found` are the phrases under anchors that occur more than once, read several times; `rows` the
    documents (rid, text); `m` the units of a window.
    """
    same = store(found.groupBy("anchor", "phrase").agg(F.min(F.struct("ord", "rid", "lo", "hi")).alias("one"), F.count("*").alias("n")), "phrases")
    whole = F.col("n") > 1 if rule == "anywhere" else F.col("ord") > F.col("one.ord")
    runs = found.join(same.filter("n > 1"), ["anchor", "phrase"]).filter(whole).select("rid", F.struct("lo", "hi").alias("span"))

    several = same.groupBy("anchor").agg(F.count("*").alias("phrases")).filter("phrases > 1")
    ask = same.join(several, "anchor").select("anchor", "phrase", "n", "phrases", "one.*")
    texts = ask.groupBy("rid").agg(F.collect_list(F.struct("anchor", "phrase", "ord", "n", "phrases", "lo", "hi")).alias("ask")).join(rows.select("rid", "text"), "rid")

    def hashes(batch: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("anchor", "phrase", "ord", "n", "phrases", "windows")}
        for text, asked in zip(batch["text"], batch["ask"]):
            u = units(text)
            for a in asked:
                for name in ("anchor", "phrase", "ord", "n", "phrases"):
                    out[name].append(a[name])
                lo, hi = a["lo"], a["hi"]
                out["windows"].append(Block(u[lo : hi + m], m, 1, lo).window_hashes(lo, hi))
        return {name: pa.array(v, pa.int64()) for name, v in out.items() if name != "windows"} | {"windows": pa.array(out["windows"], pa.list_(pa.int64()))}

    asked = store(arrow_map(texts, hashes, "anchor long, phrase long, ord long, n long, phrases long, windows array<long>"), "windows")
    each = ("anchor", "phrase", "ord", "n", F.posexplode("windows").alias("offset", "window"))
    over = Window.partitionBy("anchor", "window")
    hit = (F.col("times") > 1) & (F.col("n") == 1) if rule == "anywhere" else F.col("first") < F.col("ord")
    few = asked.filter(F.col("phrases") <= most).repartition("anchor").select(*each).withColumn("times", F.count("*").over(over)).withColumn("first", F.min("ord").over(over))
    many = asked.filter(F.col("phrases") > most).select(*each)
    many = many.join(many.groupBy("anchor", "window").agg(F.count("*").alias("times"), F.min("ord").alias("first")), ["anchor", "window"])
    hits = few.filter(hit).groupBy("anchor", "phrase").agg(F.collect_list("offset").alias("offsets"))
    hits = hits.unionByName(many.filter(hit).groupBy("anchor", "phrase").agg(F.collect_list("offset").alias("offsets")))
    hits = store(hits, "hits")
    # every row of the phrase that is not covered as a whole has these windows
    first = F.lit(True) if rule == "anywhere" else F.col("ord") == F.col("one.ord")
    open_rows = found.join(same.select("anchor", "phrase", "one").join(hits, ["anchor", "phrase"]), ["anchor", "phrase"]).filter(first)
    points = open_rows.select("rid", F.transform("offsets", lambda o: o + F.col("lo")).alias("points"))

    merged = runs.select("rid", "span", F.lit(None).cast("array<int>").alias("points")).unionByName(points.select("rid", F.lit(None).cast("struct<lo:int,hi:int>").alias("span"), "points"))
    return merged.groupBy("rid").agg(F.collect_list("span").alias("spans"), F.flatten(F.collect_list("points")).alias("points"))


def flags(spans: list[dict] | None, points: list[int] | None, n: int) -> np.ndarray:
    """One flag for each of n windows."""
    step = np.zeros(n + 1, np.int32)
    for s in spans or ():
        step[s["lo"]] += 1
        step[s["hi"] + 1] -= 1
    out = np.cumsum(step[:n]) > 0
    if points:
        out[np.array(points)] = True
    return out
