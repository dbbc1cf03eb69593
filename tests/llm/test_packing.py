import json
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from quire.llm import packing, queries
from tokenizers import Tokenizer

FILE = P.path("word_bpe_49k.json")
ODD = [None, "", "   ", "It's THE end.\n\tOK", "Größe ÉTÉ ñandú œuvre", "été İ ΣΑΣ ªº ²³¼", "漢字 かな 🙂", "a1b22 c3!!??", "<|endoftext|> x", "nbsp y z", "w " * 5000, "q" * 3000, "don't I'LL 'S x'tx"]


def reference(texts):
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check(rows, ids, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert by.keys() == ids.keys()
    for d, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids[d])
        assert all(r.length == capacity for r in own[:-1])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][r.start : r.start + r.length], "<u4").tobytes())
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
    for items in seq.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(seq)


def test_pieces_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(ODD)], "doc_id long, text string, piece int, length string").repartition(3)
    rows = packing.pack_documents(df, FILE, 64).collect()
    check(rows, dict(enumerate(reference(ODD))), 64)


def test_other_tokenizer_files_go_by_the_library(tmp_path):
    assert packing.WordTokenizer(FILE).by_chunks
    parts = json.load(open(FILE))
    parts["normalizer"]["normalizers"].pop()
    file = str(tmp_path / "cased.json")
    json.dump(parts, open(file, "w"))
    own, library = packing.WordTokenizer(file), Tokenizer.from_file(file)
    library.encode_special_tokens = True
    upto, ids = own.slice(pa.array([x or "" for x in ODD], pa.large_string()))
    assert not own.by_chunks
    assert [ids[a:z].tolist() for a, z in zip(upto, upto[1:], strict=False)] == [library.encode(x or "", add_special_tokens=False).ids for x in ODD]


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE, 64).count() == 0


def test_repeated_rows_and_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "PACK_ROWS", 50)
    rows = [(7, 0, 3)] * 30 + [(i, 0, i % 10 + 1) for i in range(200)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, piece int, length int"), 10).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted(rows)
    seq = defaultdict(list)
    for r in got:
        seq[r.sequence_id].append((r.offset, r.length))
    for items in seq.values():
        ends = [o + n for o, n in sorted(items)]
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 10


@given(st.lists(st.integers(1, 40), max_size=120))
def test_tightest_bin(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = packing.best_fit_decreasing(np.array(sizes, np.int64), 40)
    left = {}
    for size, b, o in zip(sizes, bins.tolist(), offsets.tolist(), strict=True):
        fits = [v for v in left.values() if v >= size]
        if fits:
            assert left[b] == min(fits)
        else:
            assert b not in left
        assert o == 40 - left.get(b, 40)
        left[b] = left.get(b, 40) - size


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(texts, reference(texts.values()), strict=True))
    n = check(queries.op9_best_fit_packing(spark, sf).collect(), ids, 2048)
    least = -(-sum(map(len, ids.values())) // 2048)
    assert n <= least * 1.02 + 1
