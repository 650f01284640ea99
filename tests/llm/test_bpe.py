import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from inkscan.llm.bpe import codec, encode_digests, stitch

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def expected(text):
    ids = np.asarray(codec(PATH, PATTERN).encoding.encode_ordinary(text or ""), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 12), (50, 20), (37, 5)])
def test_every_text_as_the_whole(spark, chunk, overlap):
    draw = random.Random(7)
    parts = ["the", " a", "  ", "\n\n", "it's", "é🚀", "123", " !!", "\t", "x" * 60, " " * 45, "we'll ", "日本語", "'"]
    texts = [None, "", " ", "a", *("".join(draw.choices(parts, k=draw.randint(1, 90))) for _ in range(60)), "y" * 500, " " * 500]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[10], "again"), (3, texts[10], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(df, PATH, PATTERN, chunk, overlap).collect())
    assert got == sorted((i, *expected(t)) for i, t, _ in rows)


def by_pretoken(text):
    c = codec(PATH, PATTERN)
    ids = np.array([i for m in c.pretoken.finditer(text) for i in c.single.encode_ordinary(m[0])], dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_long_runs(spark):
    """Runs that no overlap stitches, far beyond what the library's own search of the whole text stands."""
    texts = ["some words " + run * 2_000_000 + " and more words " * 9000 for run in (" ", "\n", "a", "*")]
    texts += ["x" + " \n" * 300_000 + "then words. " * 20_000 + "7" * 200_000 + " " * 70_000 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(df, PATH, PATTERN).collect())
    assert got == sorted((i, *by_pretoken(t)) for i, t in enumerate(texts))


def test_no_rows(spark):
    assert encode_digests(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).collect() == []


def test_stitch_is_the_first_common_boundary():
    c = codec(PATH, PATTERN)
    assert stitch("some words are here and ", "ds are here and ", c) == 2
    assert stitch("aaaaaaaaaaaa", "aaaaaa", c) is None


def test_white_space_at_a_cut(spark):
    """A piece that ends in white space would lose its lookahead: the cut comes later."""
    c = codec(PATH, PATTERN)
    assert stitch("a\n\nbut more", "but more", c) == 3
    texts = [f"{'a' * n}{gap}but then there are more words" for gap in ("\n\n", "\t\t", " \n", "\r\n\r\n", "  \n\n ") for n in range(8, 16)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(df, PATH, PATTERN, 16, 12).collect())
    assert got == sorted((i, *expected(t)) for i, t in enumerate(texts))
