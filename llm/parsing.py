"""Removal of passages that an earlier document has, by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller doc_id. Its index holds blocks, the
phrases that the window sampling of `llm.windows` cuts alike wherever a passage stands, each with
its earliest document. Parsing a document takes phrase after phrase that the index has from an
earlier document into the same factor, as long as it goes. Where a factor ends inside a phrase,
because the texts part there, its windows of 50 words are looked up one by one, so a factor reaches
exactly as far as its last window. Factors of 50 words or more are the duplicate spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from llm.common import arrow_map, store, with_row_ids
from llm.repeats import PHRASES, covered_windows, flags, phrases
from llm.windows import covered

WORDS, K = 50, 25


def words_of(text: str | None) -> list[bytes]:
    """Runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def drop_earlier_passages(docs: DataFrame, words: int = WORDS, k: int = K, most: int = PHRASES) -> DataFrame:
    """rid, doc_id, n_words, n_removed, kept (words joined by spaces) of every row of `docs`.

    Removed is each word of a window of `words` words that also starts in a row with a smaller
    doc_id. Null ids count as larger than all others and not smaller than each other; rows of equal
    ids don't remove each other's words. Null texts have no words. Only doc_id and text are read.
    """
    rows = with_row_ids(docs, "doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"))
    w = words - k + 1
    cut = phrases(rows, word_hashes, k, w)
    index = cut.groupBy("anchor").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").select("anchor")
    found = store(cut.join(store(index, "index"), "anchor"), "found")
    marks = covered_windows(found, rows, word_hashes, words, "before", most)

    def drop(batch: dict) -> dict:
        n_words, n_removed, kept = [], [], []
        for text, spans, points in zip(batch["text"], batch["spans"], batch["points"]):
            got = words_of(text)
            n_words.append(len(got))
            if spans or points:
                gone = covered(flags(spans, points, len(got) - words + 1), words)
                got = [x for x, g in zip(got, gone.tolist()) if not g]
            n_removed.append(n_words[-1] - len(got))
            kept.append(b" ".join(got))
        ids = {n: pa.array(batch[n], pa.int64()) for n in ("rid", "doc_id")}
        return ids | {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())}

    columns = "rid long, doc_id long, n_words long, n_removed long, kept binary"
    return arrow_map(rows.drop("ord").join(marks, "rid", "left"), drop, columns)
