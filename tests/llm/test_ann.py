import math
import random

import numpy as np
import pytest
from quire.llm import ann, queries


def product(a, b):
    """Added in the order of the coordinates, as sum() of newer Pythons carries its rounding errors along."""
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, is_query, k):
    dims = 8
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            out[i] = sorted((-product(q, x), j) for j, x in good if j != i)[:k]
    return out


def rows_with_copies(n=900, dims=8):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=dims).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[20][1]) for i in range(300)]  # a third of all is one vector
    rows += [(5000, None), (5020, []), (5040, [0.0] * dims), (5060, [float("nan")] + [1.0] * (dims - 1)), (5080, [float("inf")] + [1.0] * (dims - 1)), (5100, [None] + [1.0] * (dims - 1)), (5120, [1.0] * 3)]
    random.Random(2).shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(3)


@pytest.mark.parametrize("limits", [{}, {"LIST_SIZE": 40, "BLOCK": 64}])
def test_recall_and_scores(spark, monkeypatch, limits):
    for name, v in limits.items():
        monkeypatch.setattr(ann, name, v)
    rows = rows_with_copies()
    want = brute(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in ann.nearest(frame(spark, rows), lambda key: key % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    found = 0
    vectors = dict(rows)
    for q, own in got.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21))
        assert all(s == product(vectors[q], vectors[i]) for _, i, s in own)
        assert all(s == pytest.approx(math.fsum(float(a) * float(b) for a, b in zip(vectors[q], vectors[i], strict=True)), rel=1e-12, abs=1e-12) for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        found += len({i for _, i, _ in own} & {i for _, i in want[q]})
    assert found >= 0.9 * sum(map(len, want.values()))
    if not limits:
        assert all([(-s, i) for _, i, s in got[q]] == want[q] for q in want)


def test_few_and_none(spark):
    few = frame(spark, [(0, [1.0, 2.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5])])
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few, lambda key: key % 20 == 0, 20).collect())
    assert got == [(0, 1, 3, 1.5), (0, 2, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 3, 0.5)]
    assert ann.nearest(frame(spark, [(0, [1.0, 2.0])]), lambda key: key % 20 == 0, 20).count() == 0
    assert ann.nearest(few.limit(0), lambda key: key % 20 == 0, 20).count() == 0


def test_many_ties_go_to_smaller_ids(spark):
    # One-hot vectors: hundreds of different ones have the same score.
    rows = [(i, [1.0, *(1.0 if d == i % 390 else 0.0 for d in range(390))]) for i in range(800)]
    random.Random(3).shuffle(rows)
    want = {q: sorted((-(2.0 if i % 390 == q % 390 else 1.0), i) for i, _ in rows if i != q)[:20] for q in range(0, 800, 20)}
    got = {}
    for r in ann.nearest(frame(spark, rows), lambda key: key % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: sorted(v) for q, v in got.items()} == want
    ids, scores = ann._best(np.ones((1, 3)), np.tile(np.eye(3), (400, 1)), np.arange(1200)[::-1].copy(), 21)
    assert ids.tolist() == [list(range(21))] and (scores == 1).all()


def test_repeated_and_null_keys(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (None, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.5, 4.0]), (2, [0.25, 4.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(frame(spark, rows), lambda key: key % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 2, 0.25)]


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(4)
    c, x = rng.normal(size=(600, 16)), rng.normal(size=(200, 16))
    ids, dist = ann.CentroidGraph.of(c).search(x, 32)
    true = np.argsort(((c[None] - x[:, None]) ** 2).sum(2), 1)[:, :32]
    assert np.mean([len(set(a) & set(b)) / 32 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.9
    assert (np.diff(dist, axis=1) >= 0).all()


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in queries.op4_posting_lists(spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[int(ids[q])] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert len(got) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(got)
