"""A toxicity classifier whose score hardly moves when identity terms are swapped.

Features are hashed words and stems. A first pass over the labelled rows counts in how many texts of each label a
feature stands; the KEPT features that tell most go into the fit, and only those of a text, and of its sentences with
identity terms before and after a swap, reach the driver in a second pass.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.chunked import ChunkCache, encode_slice, slices
from quire.llm.common import written

#: Labelled rows that a fit uses at most: those with the smallest hashes of their ids.
FIT_ROWS = 12_000
#: Features are hashed into so many slots.
SLOTS = 1 << 18
#: Features that a fit keeps: those that depend most on the label.
KEPT = 4000

# Identity terms by kind; a term is swapped for others of its kind.
IDENTITY_TERMS = {
    "religion": ["muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"],
    "religious people": ["muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"],
    "origin": ["african", "american", "arab", "asian", "european", "indian", "latino", "mexican", "chinese", "japanese"],
    "colour": ["black", "white", "brown"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    "gender": ["female", "male", "transgender", "nonbinary"],
    "person": ["woman", "man", "girl", "boy"],
    "people": ["women", "men", "girls", "boys"],
    "ability": ["blind", "deaf", "disabled", "paralyzed"],
    "age": ["old", "young", "elderly", "teenage"],
}
#: Pairs of a sentence and the same with swapped terms that a fit uses at most: those with the smallest hashes.
FIT_PAIRS = 50_000

_WORD = re.compile(r"[^\W\d_]+")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SLOTS


def chunk_features(chunk: str) -> list[int]:
    """Slots of each word of a chunk and of its first four and five letters."""
    out = []
    for w in _WORD.findall(chunk.lower()):
        out.append(_slot(w))
        out += [_slot(f"{w[:k]}~") for k in (4, 5) if len(w) >= k]
    return out


def present(texts: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, code) of each feature that a text holds, once, and the number of texts; by slices. keep: slots to look at.

    A code (int) is the slot + SLOTS * (256 * log2(1 + how often the text holds it) - 256), the latter rounded; a bare slot is met once.
    """

    def encode(chunk: str) -> bytes:
        slots = chunk_features(chunk)
        return np.array(slots if keep is None else [s for s in slots if keep[s]], np.int32).tobytes()

    cache = ChunkCache(encode)
    for part in slices(texts):
        upto, slots = encode_slice(part, cache)
        row = np.repeat(np.arange(len(part)), np.diff(upto))
        pair, times = np.unique(row * SLOTS + slots, return_counts=True)
        level = np.rint(256 * np.log2(1 + times)).astype(np.int64) - 256
        yield pair // SLOTS, (pair % SLOTS + SLOTS * level).astype(np.int32), len(part)


def _value(code: np.ndarray) -> np.ndarray:
    """What a feature counts by: 1 if met once, less for each time more."""
    return 1 + (code // SLOTS) / 256


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


class Lexicon:
    """Identity terms by kind (lower case); a word is swapped for others of its kind."""

    def __init__(self, terms: dict[str, list[str]]):
        self.terms = terms
        self.kind = {term: kind for kind, own in terms.items() for term in own}

    def swaps(self, text: str) -> list[str]:
        """text with its identity terms replaced by the next, and by the last but one, term of their kinds; none if it has no such term."""
        if not any(w in self.kind for w in _WORD.findall(text.lower())):
            return []

        def other(step: int):
            def put(m: re.Match) -> str:
                word = m.group().lower()
                terms = self.terms.get(self.kind.get(word, ""))
                return terms[(terms.index(word) + step) % len(terms)] if terms else m.group()

            return put

        return [_WORD.sub(other(step), text) for step in (1, -1)]

    def pairs(self, text: str) -> list[tuple[str, str]]:
        """(sentence, the same with swapped terms) of each sentence of a text that has any."""
        return [(s, t) for s in _SENTENCE.findall(text) for t in self.swaps(s)]


IDENTITY = Lexicon(IDENTITY_TERMS)
swaps = IDENTITY.swaps


@dataclass
class ToxicityModel:
    slots: np.ndarray
    weights: np.ndarray
    bias: float
    #: How many swapped sentences the penalty was taken over; with none it has no effect.
    swapped: int = 0

    def scores(self, texts: pa.Array) -> np.ndarray:
        keep, w = np.zeros(SLOTS, bool), np.zeros(SLOTS)
        keep[self.slots], w[self.slots] = True, self.weights
        out = [np.bincount(row, w[code % SLOTS] * _value(code), n) + self.bias for row, code, n in present(texts, keep)]
        return 1 / (1 + np.exp(-np.concatenate(out).clip(-500, 500))) if out else np.zeros(0)


class _Rows:
    """A matrix by (row, column, value) of what is not 0."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.value, self.shape = row, col, value, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col] * self.value, self.shape[0])

    def t_dot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.value, self.shape[1])


def fit_logistic(x: _Rows, y: np.ndarray, a: _Rows, b: _Rows, fairness: float, sparsity: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Class-balanced logistic loss + sparsity * |w|_1 + fairness * mean (w.a - w.b)^2, by accelerated proximal steps.

    Rows of a and b are labelled sentences and the same sentences with swapped identity terms.
    """
    n, k = x.shape
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    m = max(1, a.shape[0])
    # Lipschitz bound by a few power iterations
    v, vb = np.ones(k), 1.0
    bound = 1.0
    for _ in range(12):
        u = x.dot(v) + vb
        d = a.dot(v) - b.dot(v)
        g = x.t_dot(weight * u) / 4 + 2 * fairness / m * (a.t_dot(d) - b.t_dot(d))
        gb = float((weight * u).sum()) / 4
        bound = float(np.sqrt((g * g).sum() + gb * gb)) or 1.0
        v, vb = g / bound, gb / bound
    step = 0.9 / bound
    w = np.zeros(k)
    bias = 0.0
    yw, yb, t = w, bias, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x.dot(yw) + yb).clip(-50, 50)))
        r = weight * (p - y)
        d = a.dot(yw) - b.dot(yw)
        g = x.t_dot(r) + 2 * fairness / m * (a.t_dot(d) - b.t_dot(d))
        nw = yw - step * g
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * sparsity, 0)
        nb = yb - step * float(r.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yw, yb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        w, bias, t = nw, nb, nt
    return w, bias


def telling(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The KEPT slots that depend most on the label, ascending. c1, c0: in how many of the n1 and n0 texts of each label a slot stands."""
    lift = np.abs((c1 + 0.5) / (n1 + 1) - (c0 + 0.5) / (n0 + 1)) / np.sqrt((c1 + c0 + 1.0) / max(1, n1 + n0))
    lift[c1 + c0 < 3] = 0
    return np.sort(np.argsort(-lift, kind="stable")[:KEPT])


def fit_features(rows: list[np.ndarray], y: np.ndarray, swapped: list[tuple[int | np.ndarray, np.ndarray]], fairness: float, sparsity: float, slots: np.ndarray | None = None) -> ToxicityModel:
    """rows: codes (see present) of each labelled text; swapped: (its row or codes before a swap, codes after it); slots: those to use, else the telling ones."""
    if not (y == 1).any() or not (y == 0).any():
        return ToxicityModel(np.zeros(0, int), np.zeros(0), 10.0 if (y == 1).any() else -10.0)
    if slots is None:
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        slot = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False) % SLOTS
        c1, c0 = (np.bincount(slot[y[row] == v], minlength=SLOTS) for v in (1, 0))
        slots = telling(c1, c0, int((y == 1).sum()), int((y == 0).sum()))
    at = np.full(SLOTS, -1, np.int32)
    at[slots] = np.arange(len(slots))
    # Values are scaled to a mean square of 1 where a feature is held, so a word of all texts does not slow the fit down.
    code = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
    kept = at[code % SLOTS]
    kept, value = kept[kept >= 0], _value(code[kept >= 0])
    scale = np.sqrt(np.bincount(kept, value**2, len(slots)) / np.maximum(1, np.bincount(kept, minlength=len(slots))))
    scale[scale == 0] = 1
    del code, kept, value

    def matrix(parts: list[np.ndarray]) -> _Rows:
        r = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        code = np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32, copy=False)
        c = at[code % SLOTS]
        held = c >= 0
        r, c, code = r[held], c[held], code[held]
        return _Rows(r, c, _value(code) / scale[c], (len(parts), len(slots)))

    before = [rows[i] if isinstance(i, int) else i for i, _ in swapped]
    w, bias = fit_logistic(matrix(rows), y, matrix(before), matrix([s for _, s in swapped]), fairness, sparsity)
    used = w != 0
    return ToxicityModel(slots[used], (w / scale)[used], bias, len(swapped))


def fit_toxicity(documents: DataFrame, labels: DataFrame, held_out, label: str = "toxic", key: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS, fairness: float = 10.0, sparsity: float = 3e-4, lexicon: Lexicon = IDENTITY) -> ToxicityModel:
    """Fit on at most fit_rows labelled rows for which the condition held_out(key column) does not hold.

    Rows with a null label take no part; of a repeated label row each counts, and of repeated documents as well, but at
    most fit_rows rows in all. With labels of one kind only, or none, all texts get the same score. The driver holds
    counts of SLOTS features, at most KEPT features of each row, and at most FIT_PAIRS swapped sentences.
    """
    known = labels.filter(F.col(label).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y"))
    some = known.orderBy(F.xxhash64("__k"), "__k", "__y").limit(fit_rows)
    rows = documents.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(some), "__k").select("__k", "__y", F.coalesce("__t", F.lit("")).alias("__t"))
    if rows.count() > fit_rows:
        rows = rows.orderBy(F.xxhash64("__k", "__t"), "__k", "__y").limit(fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(b.column("__y"))
            held = np.zeros((2, SLOTS + 1), np.int64)
            at = 0
            for row, code, n in present(b.column("__t")):
                own = y[at : at + n]
                for v in (0, 1):
                    held[v, :SLOTS] += np.bincount(code[own[row] == v] % SLOTS, minlength=SLOTS)
                    held[v, SLOTS] += (own == v).sum()
                at += n
            v, slot = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(held[v, slot])], ["slot", "y", "n"])

    met = rows.mapInArrow(count, "slot int, y int, n long").groupBy("slot", "y").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros((2, SLOTS + 1), np.int64)
    held[np.asarray(met["y"]), np.asarray(met["slot"])] = np.asarray(met["n"])
    slots = telling(held[1, :SLOTS], held[0, :SLOTS], int(held[1, SLOTS]), int(held[0, SLOTS]))
    keep = np.zeros(SLOTS, bool)
    keep[slots] = True

    def codes_of(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for row, code, n in present(pa.array(texts, pa.string()), keep):
            cuts = np.searchsorted(row, np.arange(n + 1))
            out += [code[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = pa.list_(pa.int32())
        for b in batches:
            texts = b.column("__t").to_pylist()
            pairs = [(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(lexicon.pairs(t))]
            at = pa.array([*range(len(texts)), *(i for i, _, _ in pairs)], pa.int64())
            place = pa.array([-1] * len(texts) + [n for _, n, _ in pairs], pa.int32())
            x = codes_of(texts + [s for _, _, (s, _) in pairs])
            other = [None] * len(texts) + codes_of([s for _, _, (_, s) in pairs])
            yield pa.RecordBatch.from_arrays([b.column("__k").take(at), b.column("__y").take(at), place, pa.array(x, codes), pa.array(other, codes)], ["__k", "__y", "place", "x", "swapped"])

    kind = documents.schema[key].dataType.simpleString()
    made = written(rows.mapInArrow(run, f"__k {kind}, __y int, place int, x array<int>, swapped array<int>"), "toxicity-features")
    got = made.filter("place < 0").select("__k", "__y", "x").toArrow().sort_by([("__k", "ascending"), ("__y", "ascending")])
    pairs = made.filter("place >= 0").orderBy(F.xxhash64("__k", "place"), "__k", "place").limit(FIT_PAIRS).select("x", "swapped").toArrow()
    lists = lambda column: [r.values.to_numpy() for r in column]
    return fit_features(lists(got["x"]), np.asarray(got["__y"]), list(zip(lists(pairs["x"]), lists(pairs["swapped"]), strict=True)), fairness, sparsity, slots)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with a score from 0 to 1 (a column of that name is replaced), from the text alone. Null counts as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return df.withColumn(out, score(F.col(text)))
