"""A quality classifier learnt from preference pairs (Bradley-Terry), with a threshold at a score quantile.

Scores are learnt from a bounded sample of labelled rows. The threshold is a quantile of the scores of all
documents: the share that lies below is the share of label 0 to be expected among them, by the frequency of the
labels at each score, so labels that cover some sources more than others do not move it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunked import slices
from quire.llm.common import written

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
FIT_ROWS = 12_000
#: Preference pairs drawn from them.
PAIRS = 60_000

# What is counted of each distinct space-separated chunk: patterns that it holds.
_PATTERNS = {
    "upper": r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$",
    "title": r"^\p{Lu}\p{Ll}",
    "bare": r"^[^\p{L}\p{N}]+$",
    "run_of_marks": r"[^\p{L}\p{N}\s]{2,}",
    "sentence_end": r"[.!?]\"?$",
    "comma": r",$",
    "digit": r"\p{N}",
    "line_break": r"\n",
    "link": r"https?:|www\.|@",
    "markup": r"[<>{}\[\]|\\]",
}
FEATURES = [*_PATTERNS, "marks_by_length", "mean_length", "long_chunk", "same_as_before", "same_as_second_before", "distinct", "log_chunks", "empty"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; null counts as empty."""
    rows = [_features(part) for part in slices(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _features(texts: pa.Array) -> np.ndarray:
    chunks = pc.split_pattern(texts, " ")
    ends = np.asarray(chunks.offsets).astype(np.int64)
    ends -= ends[0]
    coded = chunks.flatten().dictionary_encode()
    codes, words = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    length = np.asarray(pc.utf8_length(words)).astype(float)
    marks = np.asarray(pc.count_substring_regex(words, r"[^\p{L}\p{N}\s]")).astype(float)
    table = np.stack([*(np.asarray(pc.match_substring_regex(words, p)).astype(float) for p in _PATTERNS.values()), marks, length, length > 30], 1)
    n = np.diff(ends)
    doc = np.repeat(np.arange(len(n)), n)
    sums = np.stack([np.bincount(doc, table[codes, i], len(n)) for i in range(table.shape[1])], 1)

    def repeats(lag: int) -> np.ndarray:
        same = (codes[lag:] == codes[:-lag]) & (doc[lag:] == doc[:-lag])
        return np.bincount(doc[lag:][same], minlength=len(n))

    distinct = np.bincount(np.unique(doc * max(len(words), 1) + codes) // max(len(words), 1), minlength=len(n))
    by_length, k = sums[:, -3] / np.maximum(sums[:, -2], 1), np.maximum(n, 1)[:, None]
    empty = sums[:, -2] == 0
    return np.concatenate([sums[:, :-3] / k, by_length[:, None], np.log1p(sums[:, -2:-1] / k), sums[:, -1:] / k, repeats(1)[:, None] / k, repeats(2)[:, None] / k, (distinct / np.sqrt(np.maximum(n, 1)) / 10)[:, None].clip(0, 1), np.log1p(n)[:, None], empty[:, None]], 1).astype(float)


@dataclass
class PairwiseRanker:
    """score: of the margin over the threshold, a probability that equals `level` at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    level: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.margin(x) - self.threshold) + np.log(self.level / (1 - self.level))
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray, level: float, pairs: int = PAIRS, seed: int = 7) -> PairwiseRanker:
    """Weights that make the better text of each pair win: logistic loss on feature differences.

    Its threshold is the quantile of the scores at which as large a share of the fitted rows lies below as are labelled
    0, until at_quantile() puts it at one of all documents. With labels of one kind only (or none) every text gets that label's side.
    """
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return PairwiseRanker(mean, scale, np.zeros(x.shape[1]), -1.0 if len(good) else 1.0, 1.0, level)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, ridge = np.zeros(z.shape[1]), 1e-3
    for _ in range(25):  # Newton's steps
        p = 1 / (1 + np.exp((d @ w).clip(-50, 50)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), -(d.T @ p) / pairs + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    threshold = float(np.quantile(s, len(bad) / len(y), method="midpoint"))
    return PairwiseRanker(mean, scale, w, threshold, 1.0, level)


def label_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the chance of label 1 at a margin: a logistic curve, with a small ridge so that labels that are told apart fully have one too."""
    scale = float(margin.std()) or 1.0
    z = np.stack((margin / scale, np.ones(len(margin))), 1)
    w, ridge = np.zeros(2), np.array([1e-4, 1e-9])
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-(z @ w).clip(-50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(ridge), z.T @ (p - y) / len(y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def at_quantile(model: PairwiseRanker, x: np.ndarray, y: np.ndarray, documents: DataFrame, text: str) -> PairwiseRanker:
    """The model with its threshold at the quantile of all documents' margins that their expected share of label 0 is. x, y: features and labels of the fitted rows."""
    if not (y == 1).any() or not (y == 0).any():
        return model

    @F.arrow_udf("double")
    def margin(texts: pa.Array) -> pa.Array:
        return pa.array(model.margin(features(texts)))

    slope, offset = label_curve(model.margin(x), y)
    margins = written(documents.select(margin(F.col(text)).alias("m")), "margins")
    low = margins.agg(F.avg(1 / (1 + F.exp(slope * F.col("m") + offset)))).first()[0]
    if low is None:
        return model
    return replace(model, threshold=float(margins.agg(F.percentile_approx("m", low, 100_000)).first()[0]))


def fit_quality(documents: DataFrame, labels: DataFrame, held_out, level: float, label: str = "quality", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> PairwiseRanker:
    """Fit on at most fit_rows labelled rows for which the condition held_out(key column) does not hold.

    Rows with a null label take no part; of a repeated label row each counts, and of repeated documents as well, but at
    most fit_rows rows in all. With labels of one kind only, or none, all texts are on one side. Only features reach the
    driver; all documents are scored once for the threshold.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    some = known.orderBy(F.xxhash64("__k"), "__k", "__y").limit(fit_rows)
    rows = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(some), "__k").select("__k", "__y", "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("__t"))
            yield pa.RecordBatch.from_arrays([b.column("__k"), b.column("__y"), pa.array(list(x), pa.list_(pa.float64()))], ["__k", "__y", "x"])

    if rows.count() > fit_rows:
        rows = rows.orderBy(F.xxhash64("__k", "__t"), "__k", "__y").limit(fit_rows)
    kind = documents.schema[key].dataType.simpleString()
    got = rows.mapInArrow(run, f"__k {kind}, __y int, x array<double>").toArrow().sort_by([("__k", "ascending"), ("__y", "ascending")])
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.asarray(got["__y"])
    return at_quantile(fit_pairs(x, y, level), x, y, documents, text)


def score_quality(df: DataFrame, model: PairwiseRanker, text: str = "text", out: str = "score") -> DataFrame:
    """df with a score from 0 to 1 (a column of that name is replaced), from the text alone. Null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return df.withColumn(out, score(F.col(text)))
