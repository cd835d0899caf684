import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from llm.bpe import digests, encode_documents, read_ranks, split_chunks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "b ", " ", "\n", "'s", "12", "é", "日本", "!!", "  ", "\U0001f600", "x" * 90, " " * 70]


def texts(seed):
    rnd = random.Random(seed)
    return [None, "", "a", " ", "\n\n  x  ", "y" * 5000] + ["".join(rnd.choices(PIECES, k=rnd.randint(0, 300))) for _ in range(40)]


@pytest.mark.parametrize("chunk,overlap", [(50, 20), (20, 10), (1 << 15, 1 << 10)])
def test_as_the_library_does(spark, odd, chunk, overlap):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(texts(chunk)))
    out = digests(encode_documents(odd(*rows), read_ranks(spark, PATH), public_tokenizers.PATTERN, chunk, overlap)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        ids = whole.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(40, 30), (60, 30), (7, 5)])
def test_tokens_of_several_white_spaces(odd, chunk, overlap):
    """A stretch doesn't end where a run of white space is matched by what follows it."""
    ranks = {bytes([i]): i for i in range(256)} | {b"\n\n": 256, b"  ": 257, b" \n": 258}
    whole = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [("a" * 18 + "\n\n") * 40, "foo\n\nbar " * 60, "a \n  \n b  c\n\n\n" * 30, " \n" * 200 + "x", "\u2003\u2003y\n\n" * 50]
    out = encode_documents(odd(*enumerate(rows)), ranks, public_tokenizers.PATTERN, chunk, overlap).collect()
    for r in out:
        assert r.ids == ",".join(map(str, whole.encode_ordinary(rows[r.doc_id]))), r.doc_id


def test_ids_and_empty_table(spark, odd):
    ranks = read_ranks(spark, PATH)
    out = encode_documents(odd((None, "a b"), (None, "a b")), ranks, public_tokenizers.PATTERN)
    assert {(r.doc_id, r.ids, bytes(r.decoded)) for r in out.collect()} == {(None, f"{ranks[b'a']},{ranks[b' b']}", b"a b")} and out.count() == 2
    assert encode_documents(odd((1, "a")).filter("doc_id > 1"), ranks, public_tokenizers.PATTERN).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 9, 10, 11, 12, 13, 25, 100):
        text = "".join(chr(97 + i % 26) for i in range(n))
        parts = split_chunks(text, 10, 3)
        assert "".join(c[:10] if i < len(parts) - 1 else c for i, (_, c) in enumerate(parts)) == text
