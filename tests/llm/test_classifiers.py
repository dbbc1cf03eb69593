import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quire.llm import quality, queries, toxicity

TEXTS = [None, "", " ", "x", "y" * 80_000, "AAA!! BBB!!", "é ü " * 9000, "a\n\n\nb"]


def never(key):
    return F.lit(False)


@pytest.mark.parametrize("run", [
    lambda d, l: quality.score_quality(d, quality.fit_quality(d, l, never, level=0.3)),
    lambda d, l: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, l, never)),
])
def test_odd_texts_and_labels(spark, run):
    schema = "doc_id long, text string, score string, swapped int, x int, __y int"
    docs = spark.createDataFrame([(i, t, "clash", 1, 1, 1) for i, t in enumerate(TEXTS)] + [(1, "", "twice", 1, 1, 1)], schema)
    none = "doc_id long, quality int, toxic int, text string"
    for rows in ([], [(1, 1, 1, "a")], [(1, None, None, "a"), (2, 0, 0, "b")], [(i, i % 2, i % 2, "c") for i in range(8)] * 2, [(77, 1, 0, "gone")]):
        labels = spark.createDataFrame(rows, none)
        got = run(docs, labels).collect()
        assert len(got) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) == 1
        assert run(docs.limit(0), labels).count() == 0


def held_out_accuracy(spark, query, label, sf="/root/testdata/sf0.1"):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    hit = lambda y: np.mean([r.predicted == y for r in rows if r.y == y])
    return hit(0), hit(1)


def test_quality_held_out(spark):
    low, high = held_out_accuracy(spark, queries.op2_quality_pairs, "quality")
    assert low > 0.97 and high > 0.97


def test_toxicity_held_out(spark):
    clean, toxic = held_out_accuracy(spark, queries.op6_toxicity_counterfactual, "toxic")
    assert clean > 0.99 and toxic > 0.8


def test_toxicity_held_out_finds_what_was_asked_for(spark):
    clean, toxic = held_out_accuracy(spark, queries.op6_toxicity_counterfactual, "toxic")
    assert clean > 0.99 and toxic > 0.93


def test_toxicity_counts_occurrences():
    # Texts of both labels hold the word, toxic ones more often; a tenth of the clean ones are without it.
    texts = [("mild " if i % 20 == 0 else "vile " * (4 if i % 2 else 1) + "mild", i % 2) for i in range(200)]
    codes = [code for t, _ in texts for _, code, _ in toxicity.present(pa.array([t]))]
    model = toxicity.fit_features(codes, np.array([y for _, y in texts]), [], 10.0, 3e-4)
    assert (model.scores(pa.array(["vile vile vile vile mild", "vile mild", "mild"])) > 0.7).tolist() == [True, False, False]


def test_pairs_order_texts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = (x @ np.array([2.0, -1.0, 0.0, 0.5]) > 0.7).astype(int)
    model = quality.fit_pairs(x, y, 0.3, pairs=5000)
    s = model.score(x)
    assert np.mean((s >= 0.3) == (y == 1)) > 0.97
    assert abs((s < 0.3).mean() - (y == 0).mean()) < 0.01


def test_swaps():
    assert toxicity.swaps("no such term") == []
    assert toxicity.swaps("A Muslim woman") == ["A christian man", "A atheist boy"]
    own = toxicity.Lexicon({"colour": ["rot", "blau"]})
    assert own.pairs("Ein Wort. Ganz rot! Rot\nund so") == [(" Ganz rot!", " Ganz blau!"), (" Ganz rot!", " Ganz blau!"), (" Rot", " blau"), (" Rot", " blau")]
    assert own.pairs("Muslim") == [] == own.pairs("")


def test_swapped_sentences_reach_the_fit(spark):
    rows = [(i, ("vile filth. The muslim neighbour. " if i % 2 else "kind words. My old friend! ") + f"filler {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, labels, never).swapped == 120
    assert toxicity.fit_toxicity(docs, labels, never, lexicon=toxicity.Lexicon({})).swapped == 0
    fair, plain = (toxicity.fit_toxicity(docs, labels, never, fairness=f) for f in (100.0, 0.0))
    moved = lambda m: np.ptp(m.scores(pa.array(["The muslim neighbour.", "The christian neighbour.", "The atheist neighbour."])))
    assert moved(fair) < 0.5 * moved(plain)


def test_logistic_fit_like_plain_steps():
    rng = np.random.default_rng(3)
    x = (rng.random((80, 12)) < 0.4) * rng.random((80, 12))
    a, b = (rng.random((20, 12)) for _ in range(2))
    y = (x[:, 0] + x[:, 1] - x[:, 2] + 0.2 * rng.normal(size=80) > 0.2).astype(int)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    def loss(w, c):
        z = x @ w + c
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 1e-3 * np.abs(w).sum() + 2.0 * (((a - b) @ w) ** 2).mean()

    w, c = np.zeros(12), 0.0
    for _ in range(40_000):
        p = weight * (1 / (1 + np.exp(-(x @ w + c))) - y)
        g = x.T @ p + 4.0 / 20 * (a - b).T @ ((a - b) @ w)
        w = w - 0.05 * g
        w, c = np.sign(w) * np.maximum(np.abs(w) - 0.05 * 1e-3, 0), c - 0.05 * p.sum()
    rows = lambda m: toxicity._Rows(*np.nonzero(m), m[np.nonzero(m)], m.shape)
    got = toxicity.fit_logistic(rows(x), y, rows(a), rows(b), 2.0, 1e-3, steps=4000)
    assert loss(*got) <= loss(w, c) + 1e-4


def test_pairs_fit_like_plain_steps():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = (x @ np.array([1.0, -1.0, 0.3]) + rng.normal(size=60) > 0).astype(int)
    model = quality.fit_pairs(x, y, 0.3, pairs=400)
    z = (x - x.mean(0)) / x.std(0)
    draw = np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 400)] - z[draw.choice(np.flatnonzero(y == 0), 400)]
    w = np.zeros(3)
    for _ in range(5000):
        w = w - 0.3 * (-(d.T @ (1 / (1 + np.exp(d @ w)))) / 400 + 1e-3 * w)
    assert np.abs(model.weights - w).max() < 1e-4


def test_threshold_follows_all_documents(spark):
    # Half of the labels say 0, but only a tenth of the documents are of that kind.
    texts = ["Plain words stand here, one by one. Nothing else."] * 90 + ["!!! ### BUY NOW $$$ !!!"] * 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(i, 0) for i in range(90, 100)], "doc_id long, quality int")
    got = {r.doc_id: r.score >= 0.3 for r in quality.score_quality(docs, quality.fit_quality(docs, labels, never, level=0.3)).collect()}
    assert sum(got.values()) in (90, 100) and all(got[i] for i in range(90))
    curve = quality.label_curve(np.array([0.0, 1.0, 2.0, 3.0] * 50), np.array([0, 0, 1, 1] * 50))
    assert abs(1 / (1 + np.exp(-(curve[0] * 1.5 + curve[1]))) - 0.5) < 0.05


def test_counterfactual_term_lowers_false_positives():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]

    def sentence(*more):
        w = rng.sample(words, 12) + list(more)
        rng.shuffle(w)
        return " ".join(w)

    # In the labelled texts one group is mostly named in toxic ones.
    texts = [(sentence("muslim", rng.choice(["vile", "filth"])), 1) for _ in range(80)] + [(sentence(rng.choice(["vile", "filth"])), 1) for _ in range(10)]
    texts += [(sentence(), 0) for _ in range(200)] + [(sentence("christian"), 0) for _ in range(40)] + [(sentence("muslim"), 0) for _ in range(3)]
    y = np.array([v for _, v in texts])

    def slots(ts):
        out = []
        for row, slot, n in toxicity.present(pa.array(ts)):
            cuts = np.searchsorted(row, np.arange(n + 1))
            out += [slot[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    rows = slots([t for t, _ in texts])
    swapped = [(i, s) for i, (t, _) in enumerate(texts) for s in slots(toxicity.swaps(t))]
    neutral = pa.array([sentence("muslim") for _ in range(100)])
    insults = pa.array([sentence("vile", "filth") for _ in range(100)])
    with_, without = (toxicity.fit_features(rows, y, swapped, fairness, 1e-3) for fairness in (10.0, 0.0))
    assert with_.scores(neutral).mean() < 0.5 * without.scores(neutral).mean()
    assert (with_.scores(insults) > 0.7).mean() > 0.95
