import random

import pytest

from llm import lines as m
from llm.lines import boundaries, drop_repeated_lines


def earlier_runs(rows, length):
    """For each row, by plain comparison, the lines inside runs of `length` lines that stand at an
    earlier place; rows of (row number, doc_id, text), places by doc_id, then row, then position."""
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    seen, marked = set(), {}
    for rid, _, text in order:
        lines = text.split("\n") if text else []
        marked[rid] = set()
        for i in range(len(lines) - length + 1):
            window = tuple(lines[i : i + length])
            if window in seen:
                marked[rid] |= set(range(i, i + length))
            seen.add(window)
    return marked


def removed(text, kept):
    """Which lines are gone, if `kept` is what is left in order: the latest fit."""
    lines, rest = text.split("\n") if text else [], kept.split("\n")
    gone, at = set(), len(rest) - 1
    for i in range(len(lines) - 1, -1, -1):
        if at >= 0 and lines[i] == rest[at]:
            at -= 1
        else:
            gone.add(i)
    return gone


def check(rows, out, least):
    got = {r.rid: r for r in out}
    rids = sorted(got)
    assert len(rids) == len(rows)
    rows = [(rid, d, t) for rid, (d, t) in zip(rids, rows)]
    long, pairs = earlier_runs(rows, 8), earlier_runs(rows, 2)
    hit = total = 0
    for rid, doc_id, text in rows:
        r = got[rid]
        lines = text.split("\n") if text else []
        assert (r.doc_id, r.n_lines) == (doc_id, len(lines))
        # no line goes that isn't in a run of two lines or more that stands earlier
        assert r.n_removed <= len(pairs[rid])
        left = r.kept.split("\n") if r.n_removed < len(lines) else []
        assert len(left) == len(lines) - r.n_removed
        at = 0
        for i, x in enumerate(lines):  # what stays is in order, and all that stands in no earlier pair stays
            if at < len(left) and left[at] == x:
                at += 1
            else:
                assert i in pairs[rid]
        assert at == len(left)
        total += len(long[rid])
        hit += min(r.n_removed, len(long[rid]))
    assert {x for _, _, t in rows for x in (t or "").split("\n")} <= {x for r in out for x in r.kept.split("\n")} | {""}
    assert total and hit >= least * total, (hit, total)


@pytest.mark.parametrize("same_hash", [False, True])
def test_recall_of_long_runs(odd, monkeypatch, same_hash):
    if same_hash:  # candidates are told apart by their bytes
        real = m.arrow_map
        monkeypatch.setattr(m, "arrow_map", lambda df, fn, schema: real(df, fn, schema).withColumn("hash", m.F.lit(1).cast("long")) if schema.startswith("rid long, at long") else real(df, fn, schema))
    rnd = random.Random(4)
    passages = [[f"line {i} {rnd.random()}" for i in range(rnd.randint(8, 14))] for _ in range(12)]
    texts = [None, "", "one", "\n\n\n\n", "a\nb", "a\nb", "z" * 100_000 + "\n" + "y" * 100_000] + ["\n".join(f"own {i} {rnd.random()}" for i in range(3000))]
    for _ in range(60):
        parts = [p if rnd.random() < 0.7 else [f"own {rnd.random()}"] * rnd.randint(1, 3) for p in rnd.choices(passages, k=3)]
        texts.append("\n".join(x for p in parts for x in p))
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    check(rows, drop_repeated_lines(odd(*rows).coalesce(1)).collect(), 0.9)


def test_whole_table_and_empty(docs):
    check([(r.doc_id, r.text) for r in docs.collect()], drop_repeated_lines(docs).collect(), 0.9)
    assert drop_repeated_lines(docs.filter("doc_id < 0")).count() == 0


def test_repeated_rows_and_two_lines(odd):
    got = [(r.doc_id, r.n_removed, r.kept) for r in drop_repeated_lines(odd((1, "a\nb"), (1, "a\nb"), (None, "a\nb")).coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, "a\nb"), (1, 2, ""), (None, 2, "")], key=str)


def test_boundaries_shift_with_the_lines():
    passage = [f"p{i}" for i in range(60)]
    a, b = boundaries(passage), boundaries(["x", "y", "z", *passage])
    assert len({x for x in a[1:-1]} & {x - 3 for x in b[1:-1]}) >= len(a) - 4
    assert a[0] == 0 and a[-1] == 60 and all(y - x >= 2 for x, y in zip(a, a[1:]))
