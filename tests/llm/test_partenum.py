import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quire.llm import partenum, queries


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [(d, sets_of(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for v in by.values() if len(v) < 2000 for i in v for j in v if i < j}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(sets[i][1]), least[find(i)]) for i, (d, _) in enumerate(rows))


def variants(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows, texts = [], []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                k = rng.randrange(len(words))
                action = rng.random()
                if action < 0.4:
                    words[k] = rng.choice(vocab)
                elif action < 0.7:
                    del words[k]
                else:
                    words.insert(k, rng.choice(vocab))
                words = words or ["x"]
        else:
            words = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 80, 300]))]
        texts.append(" ".join(words))
    ids = list(range(n))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = variants(seed, 400) + [(10_000, None), (10_001, ""), (10_002, " \t\n"), (10_003, "A  b\tC d\ne F"), (10_004, "a b c d e f"), (10_005, "x" * 50_000 + " y"), (10_006, "É é"), (10_007, "é é")]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, component_id int, digest string").repartition(4)
    got = sorted(map(tuple, partenum.near_duplicates(df).collect()))
    assert got == brute(rows)


def test_signatures_are_shared_by_all_similar_pairs():
    rng = np.random.default_rng(5)
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 11, 15, 20, 33, 60, 100, 250, 900]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            drop = int(rng.integers(0, n // 5 + 1))
            left = a[rng.permutation(len(a))[drop:]]
            # add as many as the similarity still allows
            most = len(left) * 100 // 80 - len(a)
            b = np.unique(np.concatenate((left, rng.integers(0, 2**64, max(0, int(rng.integers(0, max(0, most) + 1))), np.uint64))))
            same, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * same >= 80 * either:
                assert len(np.intersect1d(partenum.signatures(a, 80), partenum.signatures(b, 80)))


def test_shingles_count():
    texts = ["a b c d e f", "", None, "one", "A b c d e F", " a b\tc\nd\x0be ", "ééé x y z", "x " * 9]
    found = [np.diff(upto) for upto, _ in partenum.shingle_sets(pa.array(texts))]
    assert np.concatenate(found).tolist() == [len(sets_of(t)) for t in texts]


@pytest.mark.parametrize("stretch", [20, 57, 300])
def test_long_texts_in_stretches(monkeypatch, stretch):
    rng = random.Random(stretch)
    texts = [" ".join(rng.choice(["a", "é", "long" * 30, "Bc"]) + rng.choice(["", " ", "\t"]) for _ in range(n)) for n in [0, 3, 11, 12, 13, 200, 5, 999]] + [None, "x" * 5000, " " * 900, " y" * 6 + " " * 700]
    whole = [h[a:z].tolist() for upto, h in partenum.shingle_sets(pa.array(texts)) for a, z in zip(upto, upto[1:], strict=False)]
    monkeypatch.setattr(partenum, "STRETCH", stretch)
    cut = [h[a:z].tolist() for upto, h in partenum.shingle_sets(pa.array(texts)) for a, z in zip(upto, upto[1:], strict=False)]
    assert cut == whole and [len(x) for x in whole] == [len(sets_of(t)) for t in texts]


def test_chain_and_large_group(spark):
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(300):  # each differs from the base in one word of its own place
        words = list(base)
        words[i % 100] = f"u{i}"
        rows.append((i + 5, " ".join(words)))
    for i in range(12):  # a chain: neighbours link, ends do not
        rows.append((1000 - i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 80))))
    rows += [(2000 + i, "All the same text of more than five words") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, partenum.near_duplicates(df).collect())) == brute(rows)


def test_components_of_a_long_chain(spark):
    n = 1 << 12
    names = list(range(n))
    random.Random(9).shuffle(names)
    links = spark.createDataFrame([(names[i], names[i + 1]) for i in range(n - 1)] + [(10_000, 10_001)], "a long, b long").repartition(4)
    got = {r.id: r.component for r in partenum.components(links).collect()}
    assert got == {i: 0 for i in names} | {10_000: 10_000, 10_001: 10_000}


def test_null_keys(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (7, text), (3, "x " + text * 9), (None, "x " + text * 9), (None, "all by itself and long enough"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in partenum.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (7, 7), (3, 3), (None, 3), (None, None), (5, 5)], key=str)


def test_bands_as_a_column(spark):
    sizes = [1, 2, 3, 4, 5, 6, 7, 99, 100, 1000, 123_456]
    df = spark.createDataFrame([(n,) for n in sizes], "n long").select(partenum._bands(F.col("n"), 80).alias("b"))
    assert [r.b for r in df.collect()] == [partenum.band_of(n, 80) for n in sizes]


def test_empty_and_kept(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert partenum.near_duplicates(df).count() == 0
    rows = [(3, "one two three four five six seven", "a"), (2, "one two three four five six seven", "b"), (9, None, None), (8, None, None)]
    kept = partenum.near_dedup(spark.createDataFrame(rows, df.schema))
    assert sorted(map(tuple, kept.collect())) == [(2, "one two three four five six seven", "b"), (8, None, None), (9, None, None)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op10_partenum_jaccard(spark, sf).collect())) == brute(rows)
