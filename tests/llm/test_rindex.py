import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.llm import queries, rindex


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        cover = np.zeros(len(x) + 1, np.int8)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                cover[i : i + length] = 1
        edge = np.diff(cover, prepend=np.int8(0))
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))
        out.append((len(x), runs, bytes(b for b, c in zip(x, cover, strict=False) if not c)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8), st.integers(1, 9))
def test_index_like_brute_force(texts, length):
    strings = [t.encode() for t in texts]
    count = Counter(x[i : i + length] for x in strings for i in range(len(x) - length + 1))
    for x, found in zip(strings, rindex.repeated_windows(strings, length), strict=True):
        marked = {i for a, b in zip(found[::2], found[1::2], strict=True) for i in range(a, b)}
        assert marked == {i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1}


def test_few_runs_for_repetitive_text():
    rng = random.Random(1)
    base = bytes(rng.randrange(256) for _ in range(2000))
    index = rindex.RunLengthIndex([base] * 50)
    assert index.runs < 0.1 * index.n
    assert (index.matching_statistics()[:2000] == np.arange(2000, 0, -1)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=40), min_size=1, max_size=6), st.text("abcd", max_size=60))
def test_statistics_of_a_text_outside_the_index(texts, asked):
    strings, asked = [t.encode() for t in texts], asked.encode()
    got = rindex.RunLengthIndex(strings).statistics_of(asked)
    for i, n in enumerate(got.tolist()):
        assert n == max(k for k in range(len(asked) - i + 1) if any(asked[i : i + k] in x for x in strings))


def test_runs_give_the_transform():
    index = rindex.RunLengthIndex([b"abracadabra", b"abra", b"cadabra"])
    assert index.runs == len(index.heads) == len(index.top) == len(index.bottom) < index.n
    assert index.goes[index.by_symbol].tolist() == sorted(index.goes.tolist())


def phrases():
    """Texts of a few phrases in any order: most of their grams are common, most of their windows are not."""
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(9)]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(2, 40))) for _ in range(120)]


@pytest.mark.parametrize("limits", [{"KEY_BYTES": 20_000}, {"KEY_BYTES": 2_000, "COMMON": 8}])
def test_large_keys_of_repetitive_text(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(rindex, k, v)
    texts = phrases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in rindex.remove_repeats(df, 200).collect()}
    assert got == {i: runs for i, (_, runs, _) in enumerate(brute(texts, 200))}


def test_more_keys_than_a_filter_holds(spark, monkeypatch):
    monkeypatch.setattr(rindex.Bloom, "suits", lambda self, count: False)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in rindex.remove_repeats(df, 200).collect()}
    assert got == {i: runs for i, (_, runs, _) in enumerate(brute(texts, 200))}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other, base = text(60), text(40), text(300)
    texts = [None, "", "short", "a" * 5000, "ab" * 700, text(500), text(500)]
    texts += [text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30)) for _ in range(90)]
    texts += [text(5) + other[rng.randint(0, 40) :] + text(5) for _ in range(6)]
    for _ in range(12):
        x = list(base)
        for _ in range(3):
            x[rng.randrange(len(x))] = "Z"
        texts.append("".join(x))
    texts += [texts[5]] * 3 + ["q" * 199, "q" * 200, "w" * 200, "w" * 200, "y" * 201, "x" + "v" * 199, "v" * 199 + "x"]
    return texts


@pytest.mark.parametrize("limits", [{}, {"SHARD_BYTES": 3000, "KEY_BYTES": 3000, "BLOCK": 900, "SEGMENT_WINDOWS": 50}, {"KEY_BYTES": 500, "COMMON": 5, "COMMON_LOCAL": 2}])
def test_like_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(rindex, k, v)
    texts = corpus()
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, spans int").repartition(3)
    got = {r.doc_id: r for r in rindex.remove_repeats(df, 200).collect()}
    for i, (n, runs, kept) in enumerate(brute(texts, 200)):
        assert (got[i].n_bytes, [tuple(x) for x in got[i].removed], bytes(got[i].kept)) == (n, runs, kept), i


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(4)
    t = "".join(rng.choice("abcdef ") for _ in range(500))
    df = spark.createDataFrame([(1, t), (1, t), (2, t[:150]), (1, "other")], "doc_id long, text string")
    assert sorted(bytes(r.kept) for r in rindex.remove_repeats(df, 200).collect()) == sorted([b"", b"", t[:150].encode(), b"other"])
    assert rindex.remove_repeats(df.limit(0), 200).count() == 0


def test_strip_leaves_other_columns_alone(spark):
    rng = random.Random(6)
    t = "".join(rng.choice("abcdef ") for _ in range(300))
    rows = [(1, t, "mine", 7, "r", 300), (2, "x" + t, "yours", 8, "s", 301), (3, None, None, None, None, None), (None, "é" + t, "k", 9, "u", 301)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_bytes int, removed string, n_chars long")
    got = rindex.strip_repeats(df)
    assert got.dtypes == df.dtypes
    want = [(1, "", "mine", 7, "r", 0), (2, "x", "yours", 8, "s", 1), (3, None, None, None, None, None), (None, "é", "k", 9, "u", 1)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op8_repeated_bytes(spark, sf).collect()}
    for r, (n, runs, kept) in zip(rows, brute([r.text for r in rows], 200), strict=True):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
