import pytest
from pyspark.sql import functions as F

from llm.cascade import Level, _level, build, judge, shards_for

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.example.com/en/x?y#z", "https://www.example.com/en/", "https://x.WWW.example.com/en/",
    "http://example.com/EN/", "http://example.com?/en/", "ftp://net/es/", "http://é.NET/fr/\nq", "http://internet/es/", "http://user@example.com:80/en/", "a://b://com/", "http://..com/",
    "http://" + "a." * 2000 + "net/fr/" + "x" * 100_000,
]


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string")
    for name in ("host", "rule", "key", "verdict", "html", "_hit"):
        df = df.withColumn(name, F.lit("x"))
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df, RULES).collect()}
    assert out == {i: brute(u) for i, u in enumerate(URLS + URLS[:3])}
    assert judge(df.filter("page_id < 0"), RULES).count() == 0
    assert {r.verdict for r in judge(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("every", [2, 37, 10_000])
def test_exact_over_the_universe(spark, every):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter(F.expr(f"cast(substr(key, 2) as int) % {every} = 0"))
    cascade = build(listed.union(listed), universe)
    assert universe.filter(cascade.contains(F.col("key")) != F.expr(f"cast(substr(key, 2) as int) % {every} = 0")).count() == 0


def test_empty_list(spark):
    universe = spark.createDataFrame([("a",), (None,)], "key string")
    assert universe.filter(build(universe.limit(0), universe).contains(F.col("key"))).count() == 0


@pytest.mark.parametrize("limit", [1, 9])
def test_shards(spark, limit):
    """A limit of a few bytes deals the five rules into several shards."""
    rules = spark.createDataFrame([*RULES, *RULES, (None, "net", "/"), ("block", None, "/"), ("block", "com", None), ("else", "net", "/")], "verdict string, host string, path string")
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:3])), "page_id long, url string").withColumn("_hit", F.lit("x")).withColumn("a.b", F.lit("y"))
    assert shards_for(10, 1000, limit) > 1
    rows = judge(df, rules, limit).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == {i: brute(u) for i, u in enumerate(URLS + URLS[:3])}
    assert {(r["_hit"], r["a.b"]) for r in rows} == {("x", "y")}


def test_number_of_shards():
    assert shards_for(0, 0) == shards_for(5, 5) == shards_for(10**6, 10**9) == 1
    assert shards_for(10**9, 10**12) == 35  # 9 + 4 hashes a key, 2.3 GB


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_keys_left_after_the_last_level(spark, depth):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("cast(substr(key, 2) as int) % 3 = 0")
    cascade = build(listed, universe, depth)
    assert len(cascade.levels) == depth and cascade.rest
    assert universe.filter(cascade.contains(F.col("key")) != F.expr("cast(substr(key, 2) as int) % 3 = 0")).count() == 0


def test_filter_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr("llm.cascade.BLOCK", 100)
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"))
    level = _level(keys, 2000, 1, 0.1)
    assert isinstance(level, Level) and len(level.bits) == level.size // 8 > 1000
    assert keys.filter(~level.accepts(F.col("key"))).count() == 0
    others = spark.range(10_000, 20_000).select(F.col("id").cast("string").alias("key"))
    assert 0.05 < others.filter(level.accepts(F.col("key"))).count() / 10_000 < 0.2
