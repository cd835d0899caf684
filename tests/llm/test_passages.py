import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.parsing import drop_earlier_passages
from llm.suffixes import Family, drop_repeated_bytes
from llm.windows import blocks, covered


def brute_bytes(texts, length):
    bs = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bs for i in range(len(b) - length + 1))
    out = []
    for b in bs:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def brute_words(rows, length):
    first: dict = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(first.get(key, rank(i)), rank(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < rank(i):
                gone[p : p + length] = [True] * length
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def mixed(seed, n=60):
    """Texts that share passages in many ways: borders of all kinds, copies, repeats inside a text."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abé", k=rnd.randint(1, 3)))
    passages = [" ".join(word() for _ in range(rnd.randint(3, 40))) for _ in range(12)]
    out = [None, "", " ", "x", "a" * 400, "a" * 399]
    for _ in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.6 else " ".join(word() for _ in range(rnd.randint(1, 20))) for _ in range(rnd.randint(1, 6))]
        out.append(rnd.choice([" ", "  ", "\n"]).join(parts))
    return out + out[6:12]


@pytest.mark.parametrize("most", [10_000, 1])
def test_repeated_bytes(odd, most):
    texts = mixed(1)
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeated_bytes(odd(*rows), length=24, k=12, batches=3, most=most).collect()}
    assert got == dict(enumerate(brute_bytes(texts, 24)))


@pytest.mark.parametrize("most", [10_000, 1])
def test_earlier_passages(odd, most):
    texts = mixed(2)
    ids = [i // 2 if i % 9 else None for i in range(len(texts))]
    rows = list(zip(ids, texts))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in drop_earlier_passages(odd(*rows), words=8, k=4, most=most).collect()), key=str)
    assert got == sorted(((i, *x) for i, x in zip(ids, brute_words(rows, 8))), key=str)


def test_whole_tables(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in drop_repeated_bytes(docs).collect()}
    assert got == dict(zip([i for i, _ in rows], brute_bytes([t for _, t in rows], 200)))
    words = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in drop_earlier_passages(docs).collect()}
    assert words == dict(zip([i for i, _ in rows], brute_words(rows, 50)))


def test_empty_tables(odd):
    none = odd((1, "a")).filter("doc_id > 1")
    assert drop_repeated_bytes(none).count() == 0 and drop_earlier_passages(none).count() == 0


def test_levels_merge_geometrically(spark):
    family = Family()
    for b in range(6):
        family.add(spark.range(b * 10, b * 10 + 12).select(F.col("id").alias("anchor")))
    assert [rank for rank, _ in family.levels] == [2, 1]
    assert sorted(r.anchor for r in family.repeated().collect()) == sorted(x for b in range(1, 6) for x in (b * 10, b * 10 + 1))


def test_blocks_of_a_long_sequence():
    units = np.random.default_rng(0).integers(0, 3, 3000).astype(np.uint64)
    for size in (100, 1 << 20):
        windows = [x for b in blocks(units, 5, 6, size) for p in [b.phrases()] for lo, hi in zip(p["lo"], p["hi"]) for x in range(lo, hi + 1)]
        assert windows == list(range(3000 - 9))
    hashes = np.concatenate([b.window_hashes(b.start, b.start + b.n - 1) for b in blocks(units, 5, 6, 100)])
    strings = [tuple(units[i : i + 10]) for i in range(2991)]
    assert len(set(hashes.tolist())) == len(set(strings)) == len(set(zip(hashes.tolist(), strings)))


def test_covered():
    assert covered(np.array([True, False, False, True]), 2).tolist() == [True, True, False, True, True]
