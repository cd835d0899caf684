import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from llm.exact import exact_dedup, update_state

ODD = [(3, "a  b"), (1, "a\tb"), (None, "a b"), (2, None), (5, ""), (1, "a b"), (7, " x"), (8, "x"), (9, "x" * 100_000)]


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for i, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", text or "")
        out.append((i, min((x for x in groups[norm] if x is not None), default=None), len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def test_odd_rows(spark, odd):
    out = exact_dedup(spark, odd(*ODD))
    assert shown(out) == brute(ODD)
    assert out.filter("kept").count() == len({r[3] for r in brute(ODD)})


def test_colliding_digests_are_told_apart(spark, odd):
    weak = lambda text: F.pmod(F.length(text), F.lit(2)).cast("string")
    out = exact_dedup(spark, odd(*ODD), digest=weak)
    assert shown(out) == brute(ODD)
    assert out.filter("kept").count() == len({r[3] for r in brute(ODD)})


def test_empty_table(spark, odd):
    assert exact_dedup(spark, odd((1, "a")).filter("doc_id > 1")).count() == 0


def test_state_goes_on_with_new_files(spark, docs, tmp_path):
    path, checkpoint = str(tmp_path / "docs"), str(tmp_path / "state")
    docs.filter("doc_id % 2 = 0").repartition(3).write.parquet(path)
    update_state(spark, path, checkpoint, batch_bytes=1).count()
    docs.filter("doc_id % 2 = 1").repartition(3).write.mode("append").parquet(path)
    state = update_state(spark, path, checkpoint, batch_bytes=1)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r["first"].id, r.n) for r in state.collect()) == sorted({(k, n) for _, k, n, _ in brute(rows)})


def test_a_path_with_a_trailing_slash(spark, odd, tmp_path):
    odd(*ODD).coalesce(1).write.parquet(str(tmp_path / "d"))
    assert shown(exact_dedup(spark, f"{tmp_path}/d/")) == brute(ODD)
