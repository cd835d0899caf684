import zlib

from llm.language import UNKNOWN, counts, identify, predict, train


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify(docs).collect()
    assert len(out) == docs.count()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)
    assert sum(r.rejected for r in out) < 0.01 * len(out)


def test_only_allowed_rows_train(spark, odd):
    rows = [(i, ("aaa bbb" if i % 2 else "zzz yyy") * (i % 5 + 1)) for i in range(120)]
    df = odd(*rows).drop("lang")
    lied = [(i, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else ("one" if i % 2 else "two")) for i in range(120)]
    model = train(df.join(spark.createDataFrame(lied, "doc_id long, lang string"), "doc_id"))
    assert model.languages == ["one", "two"]
    out = {r.doc_id: r for r in predict(odd(*rows, (None, None), (500, "12 !"), (501, "")), model).collect()}
    assert all(out[i].lang_pred == ("one" if i % 2 else "two") for i, _ in rows)
    assert out[None].lang_pred == out[500].lang_pred == out[501].lang_pred == UNKNOWN
    assert out[500].score == 0 and out[500].rejected


def test_nothing_to_learn(odd, spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert identify(df).first().lang_pred == UNKNOWN
    assert identify(df.filter("doc_id > 1")).count() == 0


def test_long_texts_are_read_whole():
    import llm.language as m

    text = "abc défg " * 50
    whole = counts(text)
    before, m.STRETCH = m.STRETCH, 37
    try:
        assert (counts(text) == whole).all()
    finally:
        m.STRETCH = before
