import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from llm.components import components
from llm.simhash import anchors, first_of_each, fingerprint, links, simhash_components


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def shown(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_fingerprints():
    for text in (None, "", "  ", "A", "a B", "É x y z\tw", "q " * 5000):
        assert fingerprint(text) == brute_fingerprint(text)


def test_anchors_cover():
    rnd = random.Random(1)
    for blocks in (1, 2):
        for _ in range(100):
            a = rnd.getrandbits(64)
            b = a ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 2)))
            assert anchors().of(a, blocks)[0][0] in {c for c, _ in anchors().of(b, blocks)}


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(500, i) for i in range(501, 560)] + [(7, 559), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert {out[i] for i in range(100, 141)} == {100} and {out[i] for i in range(500, 560)} == {7} and out[7] == 7
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_join_all_that_are_near(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, 30)
    fps = {int(c) for c in centres}
    for c in centres:
        x = int(c)
        for _ in range(12):
            x ^= int(np.array(1 << rng.integers(0, 63), np.int64)) ^ int(np.array(1 << rng.integers(0, 63), np.int64))
            fps.add(x)
    fps = sorted(fps)
    want = set()
    arr = np.array(fps)
    i, j = np.nonzero(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(arr[i].tolist(), arr[j].tolist()):
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = {f: find(f) for f in fps if find(f) != f or any(find(g) == f and g != f for g in fps)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for blocks, homes in ((1, 4096), (1, 2), (2, 4096)):
        got = {r.node: r.root for r in components(links(frame, blocks, homes)).collect()}
        assert got == want


def test_odd_rows(odd):
    rows = [(4, "a b c d"), (2, "A b\tc  d"), (None, "a b c d"), (None, "zz"), (3, None), (9, ""), (2, "a b c d"), (11, "one two")]
    assert shown(simhash_components(odd(*rows))) == brute_components(rows)
    assert sorted((r.doc_id for r in first_of_each(odd(*rows)).collect()), key=str) == [11, 2, 3, None]
    assert simhash_components(odd((1, "a")).filter("doc_id > 1")).count() == 0


def test_whole_table(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert shown(simhash_components(docs)) == brute_components(rows)
    kept = first_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute_components(rows)}
    assert kept.filter(F.col("text").isNull()).count() <= 1
