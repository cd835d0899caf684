import random

from pyspark.sql import functions as F

import corpus_pipeline as p
from llm import jaccard
from llm.jaccard import first_of_similar, shingles
from llm.simhash import fingerprint_of


def brute_kept(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(least.values())


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.random()}"
    return " ".join(words)


def test_stage_drops_edited_copies(spark, odd, sf):
    rnd = random.Random(4)
    rows = []
    for i in range(30):
        words = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        rows += [(10 * i, " ".join(words)), (10 * i + 1, edited(rnd, words, 3)), (10 * i + 2, edited(rnd, words, 6)), (10 * i + 3, edited(rnd, words, 40))]
    kept = p.drop_near_copies(spark, odd(*rows), sf)
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows) == sorted(i for k in range(30) for i in (10 * k, 10 * k + 3))


def test_whole_table_and_slots(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_kept(rows)
    for homes in (4096, 1):
        kept = first_of_similar(docs, homes)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert kept.filter(F.col("text").isNull()).count() <= 1


def test_odd_rows(odd):
    rows = [(4, "a b c d e f"), (2, "A b\tc  d e f"), (None, "a b c d e f"), (None, "zz"), (3, None), (9, ""), (2, "a b c d e f"), (11, "one two")]
    assert sorted((r.doc_id for r in first_of_similar(odd(*rows)).collect()), key=str) == [11, 2, 3, None]
    assert first_of_similar(odd((1, "a")).filter("doc_id > 1")).count() == 0


def test_candidates_of_simhash_groups(spark):
    """Texts whose fingerprints are 2 or fewer bits apart are compared, without any band, and linked only if alike."""
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1])]
    prints = [fingerprint_of(shingles(t)) for t in texts]
    assert 0 <= (prints[0] ^ prints[1]).bit_count() <= 2 < (prints[0] ^ prints[2]).bit_count()
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    # the fourth has another text, but a fingerprint 2 bits from the third's
    texts.append("another text altogether it is")
    signed.append(signed[2] ^ 3)
    keys = spark.createDataFrame([(i, fp, []) for i, fp in enumerate(signed)], "rid long, fp long, keys array<long>")
    grouped = jaccard.store(jaccard._with_groups(keys), "keys")
    found = {r.rid: r["keys"] for r in grouped.collect()}
    assert found[0] == found[1] and found[2] == found[3] and found[0] != found[2] and all(len(k) == 1 for k in found.values())
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    assert [sorted((r.a, r.b)) for r in jaccard.jaccard_links(rows, grouped).collect()] == [[0, 1]]
