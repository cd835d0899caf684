import random

from llm.edits import budget, contamination, least_distance, pieces, plain, without_items

ITEM = "The quick brown fox, it is said, jumps over the lazy dog near the river bank today."


def brute(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance():
    rnd = random.Random(3)
    for _ in range(300):
        a = bytes(rnd.choices(b"ab", k=rnd.randint(1, 90)))
        b = bytes(rnd.choices(b"ab", k=rnd.randint(0, 60)))
        assert least_distance(a, b) == brute(a, b)


def test_pieces_cover_the_item():
    item = plain(ITEM)
    assert b"".join(p for _, p in pieces(item)) == item and len(pieces(item)) == budget(item) + 1


def test_against_brute_force(spark, odd):
    rnd = random.Random(5)
    items = [" ".join("".join(rnd.choices("abcd", k=rnd.randint(1, 6))) for _ in range(rnd.randint(8, 25))) for _ in range(8)]
    texts = [None, "", ITEM.upper(), "x " * 2000 + ITEM + " y" * 2000, "a SHORT one", "short", "shorter", "foreshort", "q, short!", "x" * 200_000 + " short"]
    for _ in range(40):
        t = list(rnd.choice(items))
        for _ in range(rnd.randint(0, 12)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "zz"])
        texts.append("lead " + "".join(t) + " tail")
    every = [*items, ITEM, None, "", "short", "short"]
    frame = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(every)], "item_id long, text string")
    out = {r.doc_id: r for r in contamination(odd(*enumerate(texts), (99, "Short!")), frame).collect()}
    for n, text in enumerate(texts):
        want = []
        for i, item in enumerate(every):
            p = plain(item)
            if len(p) >= 32 and (d := brute(p, plain(text))) <= budget(p):
                want.append((i if i != 3 else None, d))
            elif 0 < len(p) < 32 and b" %s " % p in b" %s " % plain(text):
                want.append((i if i != 3 else None, 0))
        assert sorted(zip(out[n].item_ids, out[n].distances), key=str) == sorted(want, key=str), n
        assert out[n].contaminated == bool(want) and out[n].n_items == len(want)
    assert out[99].item_ids == [11, 12]
    kept = {r.doc_id for r in without_items(odd(*enumerate(texts)), frame).collect()}
    assert kept == {n for n in range(len(texts)) if not out[n].contaminated}


def test_blocks_of_items_give_the_same(spark, odd, monkeypatch):
    import llm.edits as m

    frame = spark.createDataFrame([(1, ITEM), (2, ITEM[:50]), (3, "nothing like that is in any of the documents here")], "item_id long, text string")
    df = odd((1, ITEM), (2, "zzz"), (2, "zzz"), (None, ITEM[:60]))
    shown = lambda: sorted(((r.doc_id, r.item_ids) for r in contamination(df, frame).collect()), key=str)
    whole = shown()
    monkeypatch.setattr(m, "BLOCK_BYTES", 1)
    assert shown() == whole and len(whole) == 4


def test_empty_tables(spark, odd, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(odd((1, "a")), none).first().n_items == 0
    assert without_items(odd((1, "a")).filter("doc_id > 1"), none).count() == 0
