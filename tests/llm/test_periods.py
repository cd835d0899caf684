import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from llm import periods as m
from llm.periods import SquareCatcher, collapse_runs
from llm.queries import QUERIES


def brute(words):
    """Every stretch of two periods or more that no neighbour extends, with its smallest period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e, p) for (s, e), p in found.items())


def sequences(rnd, count, most=60):
    for _ in range(count):
        n, kinds = rnd.randint(0, most), rnd.choice([1, 2, 2, 3, 5])
        words = [rnd.randrange(kinds) for _ in range(n)]
        if n > 4 and rnd.random() < 0.3:
            a = rnd.randrange(n)
            p = rnd.randint(1, max(1, (n - a) // 2))
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        yield words


@pytest.mark.parametrize("same_hash", [False, True])
def test_squares_in_pieces_of_any_length(monkeypatch, same_hash):
    if same_hash:  # runs are told apart by their words
        monkeypatch.setattr(m, "mix", lambda h: h * np.uint64(0))
    rnd = random.Random(11)
    for words in sequences(rnd, 40 if same_hash else 200, 24 if same_hash else 60):
        for step in (1, 7, len(words) + 1):
            catcher = SquareCatcher()
            for i in range(0, len(words), step):
                new = catcher.append(np.array(words[i : i + step]))
                assert all(e > i for _, e, _ in new.tolist())
            assert list(zip(*(x.tolist() for x in catcher.runs()))) == brute(words)


def test_one_word_over_and_over_and_thue_morse():
    catcher = SquareCatcher()
    catcher.append(np.zeros(100_000, np.int64))
    assert [x.tolist() for x in catcher.runs()] == [[0], [100_000], [1]]
    word = [0]
    while len(word) < 4096:  # no cubes, and equal polynomial hashes for unequal halves
        word += [1 - x for x in word]
    catcher = SquareCatcher()
    catcher.append(np.array(word))
    start, end, period = catcher.runs()
    assert len(start) and (end - start < 3 * period).all()


def expected(doc_id, text, plant):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = [(s, e - s, p) for s, e, p in stretches(words)]
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    rest = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()


def stretches(words):
    """Runs of four periods and six words, by comparing the words with themselves moved on."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, found = np.array([codes[w] for w in words]), {}
    for p in range(1, len(x) // 4 + 1):
        cut = np.flatnonzero(x[:-p] != x[p:])
        lo, hi = np.append(-1, cut) + 1, np.append(cut, len(x) - p) + p
        for s, e in zip(lo.tolist(), hi.tolist()):
            if e - s >= 2 * p:
                found.setdefault((s, e), p)
    return sorted((s, e, p) for (s, e), p in found.items() if e - s >= max(6, 4 * p))


def rows(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf, docs):
    want = sorted((expected(r.doc_id, r.text, True) for r in docs.collect()), key=str)
    assert rows(QUERIES["op11_dyadic_squares"](spark, sf)) == want
    assert sum(x[1] > 0 for x in want) > 10


def test_nulls_empty_long_and_repeated_rows(odd, monkeypatch):
    monkeypatch.setattr(m, "PIECE", 3000)
    rnd = random.Random(3)
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "ß ß\x0bß ß\x0cß ß ß", "A a A a A a a a a", "x x x x"]
    texts += [" ".join(f"w{x}" for x in words) for words in sequences(rnd, 40, 80)]
    texts += ["la la " * 3000, " ".join(f"w{i % 700}" for i in range(3500)), "a b c d " * 3 + "a b c"]
    pairs = [(i // 2 if i % 5 else None, t) for i, t in enumerate(texts)] * 2
    want = sorted((expected(i, t, False) for i, t in pairs), key=str)
    assert rows(m.run_digests(collapse_runs(odd(*pairs).repartition(3)))) == want
    got = collapse_runs(odd((1, "b a a a a a a c"), (None, None))).orderBy("doc_id").collect()
    assert bytes(got[1].collapsed) == b"b a c" and [tuple(r) for r in got[1].runs] == [(1, 6, 1)]
    assert got[0].n_words == 0 and got[0].runs == [] and bytes(got[0].collapsed) == b""
    assert rows(m.run_digests(collapse_runs(odd((1, "x")).filter("doc_id > 1")))) == []
    with pytest.raises(ValueError):
        collapse_runs(odd((1, "x")), exponent=1)
