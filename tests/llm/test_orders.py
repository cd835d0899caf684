import random
import re
from collections import defaultdict

import numpy as np
import pytest

from llm import orders as m
from llm.orders import similar_sets
from llm.queries import QUERIES


def shingle_set(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def brute(rows):
    """rows of (doc_id, text): all pairs that share a shingle, by whole sets."""
    sets, holders, root = [shingle_set(t) for _, t in rows], defaultdict(list), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for other in {j for x in s for j in holders[x]}:
            if 100 * len(s & sets[other]) >= 90 * len(s | sets[other]):
                root[find(i)] = find(other)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(((d, len(s), None if least[find(i)][0] else least[find(i)][1]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def families(rnd, count, size, words=60):
    out = []
    for f in range(count):
        text = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([words, 3 * words]))]
        for _ in range(size):
            new = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                new[rnd.randrange(len(new))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(new))
            if rnd.random() < 0.3:
                text = new  # chains: the ends are far apart
    return out


def test_prefixes_keep_every_pair():
    rnd = np.random.default_rng(1)
    counts = np.ones(1 << 8, np.uint32) * 2
    for n in (1, 2, 3, 9, 10, 11, 40, 200):
        base = rnd.integers(0, 1 << 63, n).astype(np.uint64)
        for gone in range(n + 1):
            other = np.unique(np.concatenate([base[gone:], rnd.integers(0, 1 << 63, gone).astype(np.uint64)]))
            a, b = np.unique(base), other
            if m.similar(a, b, m.LEAST):
                assert np.intersect1d(m.by_rarity(a, counts, 8), m.by_rarity(b, counts, 8)).size
                assert all(np.intersect1d(m.by_hash(a, s), m.by_hash(b, s)).size for s in m.SEEDS)


@pytest.mark.parametrize("homes, bits", [(1 << 18, None), (30, 12)])
def test_against_brute_force(odd, homes, bits):
    rnd = random.Random(8)
    texts = [None, "", " \n", "a", "A", "a b", "B a", "a b c", "a\tb\x0bc", "a b c d", "Ä b c", "ä b c", "one two " * 30_000]
    texts += families(rnd, 6, 30) + families(rnd, 40, 2, 8)
    texts += [" ".join(["hot"] * 3 + [f"z{rnd.randrange(40)}" for _ in range(4)]) for _ in range(40)]  # many unlike texts share a token
    rows = [(rnd.choice([None, *range(200)]) if n % 9 == 0 else n, t) for n, t in enumerate(texts)]
    rows += rows[10:40]
    rnd.shuffle(rows)
    assert result(similar_sets(odd(*rows).repartition(4), homes, bits)) == brute(rows)


def test_query_against_brute_force(spark, sf, docs):
    got = result(QUERIES["op13_order_join"](spark, sf))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(d != c for d, _, c in got)


def test_batches_longer_than_a_piece(odd):
    """Texts past the first piece of an Arrow batch, none of them null, have their own sets."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("aAbBcCdDeEfF") * (1 + i % 7) for _ in range(1 + i % 40))) for i in range(3 * m.ROWS)]
    rows += [(10_000 + i, text.swapcase()) for i, text in rows[-50:]]
    assert result(similar_sets(odd(*rows).coalesce(1))) == brute(rows)


def test_empty(docs):
    assert similar_sets(docs.filter("doc_id < 0")).count() == 0


def member(rid, tokens):
    second, third = (m.by_hash(tokens, seed).tolist() for seed in m.SEEDS)
    return m.Member({"rid": rid, "part": rid, "n": len(tokens), "second": second, "third": third})


def test_one_shared_prefix_token_is_not_enough():
    """Unlike sets that share a token of each prefix aren't candidates; similar sets always are."""
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 1 << 63, 400).astype(np.uint64))
    hot = np.concatenate([a[np.argsort(m.mix(a ^ seed))[:2]] for seed in m.SEEDS])
    b = np.unique(np.concatenate([hot, rnd.integers(0, 1 << 63, 400).astype(np.uint64)]))
    one, other = member(1, a), member(2, b)
    assert one.second & other.second and one.third & other.third
    assert not one.may_match(other) and not other.may_match(one)
    for n in (1, 2, 3, 9, 10, 11, 19, 40, 200):
        base = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
        for gone in range(n):
            for added in range(n // 8 + 2):
                new = np.unique(np.concatenate([base[gone:], rnd.integers(0, 1 << 63, added).astype(np.uint64)]))
                if m.similar(base, new, m.LEAST):
                    assert member(1, base).may_match(member(2, new)) and member(2, new).may_match(member(1, base))


def test_groups_end_where_sizes_step(spark):
    """Sets that share a token, but are too unlike in size, are no group; copies of a set count once."""
    sizes = {1: 10, 2: 11, 3: 13, 4: 40, 5: 44, 6: 48, 7: 60}
    rows = [(node, n, [7, 8] if node < 6 else [7]) for node, n in sizes.items()]
    got = m._members(spark.createDataFrame(rows + rows[2:4], "node long, n long, first array<long>")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.x, r.y, r.size), []).append(r.node)
    assert sorted(sorted(g) for g in groups.values()) == [[1, 2], [4, 5], [4, 5, 6]]
    assert all(size == len(g) for (_, _, size), g in groups.items())


def test_only_wanted_rows_and_a_few_others_move(spark):
    rows = spark.range(20_000).selectExpr("id << 40 | id % 7 as rid")
    wanted = rows.filter("rid % 20 = 0")
    got = {r.rid for r in m._among(rows, wanted).collect()}
    some = {r.rid for r in wanted.collect()}
    assert some <= got and len(got) < 2 * len(some)
    assert m._among(rows, wanted.limit(0)).count() == 0
