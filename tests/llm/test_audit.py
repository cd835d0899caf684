import random
import re
from itertools import permutations

import pytest

from llm import audit as m
from llm.audit import Trie, failures, interactions

MOST = 1 << 62


def brute(rows, labels):
    """rows of (doc_id, text, part), labels of (doc_id, quality, toxic)"""
    docs = []
    for i, text, part in rows:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any((o or "") == t and (MOST if j is None else j) < (MOST if i is None else i) for j, o, _ in rows),
        }
        good, toxic = (any(x[0] == i and x[k] == 1 for x in labels if i is not None) for k in (1, 2))
        docs.append((part or "", fails, good, toxic))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                failing = [d for d in docs if d[0] == part and d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(sum(d[1].values()) == 1 for d in failing)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_trie_holds_the_smallest_ids():
    rnd = random.Random(2)
    for _ in range(200):
        texts = ["".join(rnd.choices("ab", k=rnd.randint(0, 8))).encode() for _ in range(40)]
        rows = [((False, rnd.randrange(20)), t) for t in texts]
        trie, copies = Trie(), []
        for n, (order, text) in enumerate(rows):
            copies += [r for r, k in trie.add(text, order, (order[1], text)) for _ in range(k)]
        first = [r for r, k in trie.first() for _ in range(k)]
        least = {t: min(o for o, x in rows if x == t) for t in texts}
        assert sorted(first) == sorted((o[1], t) for o, t in rows if o == least[t])
        assert sorted(first + copies) == sorted((o[1], t) for o, t in rows)


@pytest.mark.parametrize("depths, seen", [((8, 32, 128, 512, 2048), 16 << 20), ((1, 2, 3), 0)])
def test_against_brute_force(spark, monkeypatch, depths, seen):
    monkeypatch.setattr(m, "DEPTHS", depths)
    monkeypatch.setattr(m, "SEEN_BYTES", seen)
    rnd = random.Random(5)
    texts = [None, "", " \t", "é" * 11 + "AB", "ABC", "x" * 100_000, "y" * 99_999 + "|"]
    for _ in range(25):
        words = rnd.choices([f"w{i}" for i in range(rnd.choice([20, 5000]))], k=rnd.choice([3, 99, 100, 150]))
        texts.append(rnd.choice(["", "START ", "same start " * 50]) + " ".join(words) + rnd.choice(["", "", " #", " BIG" * 40]))
    rows = [(rnd.choice([None, *range(30)]), rnd.choice(texts), rnd.choice([None, "", "en", "de"])) for _ in range(150)]
    rows += [(None, texts[8], "en")] * 5 + [(3, texts[9], "en")] * 40
    labels = [(rnd.choice([None, *range(30)]), rnd.choice([None, 0, 1]), rnd.choice([None, 0, 1])) for _ in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "2 AS mask", "'x' AS n").repartition(5)
    out = interactions(failures(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions(failures(docs.filter("doc_id > 1")), labels).count() == 0
    got = interactions(failures(docs), labels).collect()
    assert len(got) == 600 and {r.part for r in got} == {""} and all(r.removed == (r.filter_order[r.step - 1] == "A") for r in got)
