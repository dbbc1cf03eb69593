import base64
import hashlib

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import bpe, queries

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "a\n\n  b\n", "it's 'tis I'll don 't", "tab\t x", "nbsp  x  y", "  z",
    "12 345 é ü ß 漢字 かな 🙂 👩‍👩‍👧 x", "!!! ??? $$$", "nul\0 x", "\x1c \x1d x", "\x85 y", "a\x0b b", "é a", "word " * 30_000, "a" * 90_000, "ab " * 9 + "!" * 70_000 + " x y",
    "x\r\n y", "<|endoftext|> z",
]


def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, decoded int").repartition(3)
    enc = plain()
    got = {r.doc_id: r for r in bpe.bpe_decode(bpe.bpe_encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(ODD):
        assert got[i].ids == enc.encode_ordinary(t or ""), ascii(t)[:40]
        assert bytes(got[i].decoded) == (t or "").encode()


CODEC = bpe.Codec(RANKS, P.PATTERN)
MIXED = st.text(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000aZé漢かͅʰ1٣²Ⅷ_-'’s.!🙂\u0301\u200d", max_size=24)


@settings(max_examples=400, deadline=None)
@given(st.lists(MIXED, max_size=6))
def test_same_ids_on_mixtures(texts):
    got = [ids[a:z].tolist() for upto, ids in CODEC.batch(pa.array(texts, pa.string())) for a, z in zip(upto, upto[1:], strict=False)]
    assert got == [CODEC.encoding.encode_ordinary(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(MIXED, st.integers(1, 9))
def test_same_ids_of_long_texts(text, times):
    whole = CODEC.encoding.encode_ordinary(text * times)
    short = bpe.LONG
    try:
        bpe.LONG = 5
        assert CODEC.ids(text * times) == whole
    finally:
        bpe.LONG = short


def test_very_long_runs(spark):
    texts = [" " * 400_000 + "a", "\n" * 300_000 + " b", "z" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.bpe_decode(bpe.bpe_encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in got} == dict(enumerate(texts))


def test_empty_table_and_partial_bytes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(empty, RANKS, P.PATTERN), RANKS, P.PATTERN).count() == 0
    half = plain().encode_ordinary("漢")[:1]
    df = spark.createDataFrame([(half,), (None,)], "ids array<int>")
    assert {bytes(r.decoded) for r in bpe.bpe_decode(df, RANKS, P.PATTERN).collect()} == {plain().decode_bytes(half), b""}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    enc = plain()
    rows = queries.op1_byte_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
