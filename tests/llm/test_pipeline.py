import base64
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as p
from llm.edits import budget, least_distance, plain
from llm.language import identify


def word_shingles(text):
    """Five words, A-Z lower-cased; fewer words are one shingle."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in p.STAGES] == ["language", "exact_copies", "near_copies", "benchmark", "tokens"]
    kept = {}
    known = [r for r in identify(docs).collect() if not r.rejected]
    rows = {r.doc_id: r.text for r in known}
    kept["language"] = set(rows)

    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    kept["exact_copies"] = set(first.values())

    sets = {i: word_shingles(rows[i]) for i in sorted(kept["exact_copies"])}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = sets[a] | sets[b]
            if 5 * len(sets[a] & sets[b]) >= 4 * len(both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept["near_copies"] = {find(i) for i in ids}

    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(len(i) >= 32 for i in items)
    kept["benchmark"] = {i for i in kept["near_copies"] if not any(least_distance(x, plain(rows[i])) <= budget(x) for x in items)}
    assert len(kept["benchmark"]) < len(kept["near_copies"]) < len(rows)

    out = docs
    for name, stage in p.STAGES[:-1]:
        out = p.store(stage(spark, out, sf), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == kept[name], name

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(p.RANKS), "rb"))}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    last = {r.doc_id: r for r in p.run(spark, sf).collect()}
    assert set(last) == kept["benchmark"]
    for i, r in last.items():
        ids = whole.encode_ordinary(rows[i])
        assert r.n_tokens == len(ids) and r.ids == ",".join(map(str, ids))


def test_stages_take_odd_rows(spark, odd, sf):
    rows = [(1, "the cat and the dog"), (1, "the cat and the dog"), (None, "the cat and the dog"), (None, None), (2, ""), (3, "x" * 70_000), (4, "12 34")]
    out = odd(*rows)
    from pyspark.sql import functions as F

    out = out.withColumns({"lang": F.when(F.col("doc_id").isNotNull(), "en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    empty = out.filter("doc_id > 100")
    for name, stage in p.STAGES:
        out, empty = p.store(stage(spark, out, sf), name), p.store(stage(spark, empty, sf), name)
        assert empty.count() == 0
    assert {r.doc_id for r in out.collect()} <= {1, 3}


def test_stages_keep_columns_of_any_name(spark, docs, sf):
    """Columns that a stage's operator adds under the same name keep their values and types."""
    from pyspark.sql import functions as F

    names = ("score", "lang_pred", "rejected", "kept", "group_size", "keep_id", "text_sha256", "rid", "digest", "root", "score_given", "a.b")
    given = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, given, sf)
        assert out.columns == given.columns and out.dtypes == given.dtypes, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name
