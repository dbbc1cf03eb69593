"""Repeated passages by run-length compressed Burrows-Wheeler indexes.

A window is a string of `length` bytes inside one text. Every window has a key, which depends on its
content alone: the least hash of its GRAM-byte strings. Windows next to each other mostly have the same
key; such a run is a segment, and the texts of a key's segments are all that a window of that key
can match. So segments with a key that is met once are left out (a Bloom filter of repeated keys may pass
more, never fewer), equal segments are joined into one with a count (more than one: all of its windows
repeat), and the others are dealt by key to shards. A shard's segments, with separators, are one
string: its suffix array gives the Burrows-Wheeler transform, of which only the runs' first and last
entries are kept, with the length that they share with the entry above and below. Between two such
samples, the matching statistic falls by one with each position; so streaming along the text gives
at each position how long a match elsewhere is, and those of `length` bytes or more are marked.

Strings that very many texts share would give keys with large shards where they border on other text.
Their grams (met often in a batch, and often in all) lose against any other gram, so that a window with
any byte of other text has a key of that text. The segments of a key that are still larger than KEY_BYTES
are cut again by keys of their own, in which what is common among them loses; and what even then is too
large for one index is indexed in parts, each pair of parts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bloom import Bloom, bloom
from quire.llm.chunked import slices
from quire.llm.common import discard, give_back, lookup_join, written
from quire.llm.partenum import _mix, _stream

GRAM = 40
#: Segments are cut after so many windows.
SEGMENT_WINDOWS = 512
#: Bytes of segments in a shard, about: small enough for a processor's cache.
SHARD_BYTES = 256 << 10
#: Segments of a key with more bytes get new keys; what is larger still is indexed in parts of half as much.
KEY_BYTES = 2 << 20
#: A gram is common if it is met so often in all, counted where a batch has its key COMMON_LOCAL times.
COMMON, COMMON_LOCAL = 64, 8
#: Bytes that are hashed at once: what a processor's cache holds with all intermediate arrays.
BLOCK = 64 << 10
#: Bytes of segments that a worker collects before it hands them on.
HANDED_ON = 4 << 20

_U = np.uint64
_BYTES = _stream(21, 256)
_P = 0x9E3779B97F4A7C15 | 1
_TOP = _U(1 << 63)


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of each GRAM bytes, by doubling. The top bit is clear."""
    steps, size = {1: _BYTES[data]}, 1
    while 2 * size <= GRAM:
        h = steps[size]
        steps[2 * size] = h[:-size] * _U(pow(_P, size, 1 << 64)) + h[size:]
        size *= 2
    out, have = steps[size], size
    while have < GRAM:
        size = max(s for s in steps if s <= GRAM - have)
        n = len(data) - have - size + 1
        out = out[:n] * _U(pow(_P, size, 1 << 64)) + steps[size][have : have + n]
        have += size
    return _mix(out) >> _U(1)


def _salted(data: np.ndarray, salt: int) -> np.ndarray:
    g = _grams(data)
    return _mix(g ^ _U(salt)) >> _U(1) if salt else g


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over each width neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return x if size == width else f(x[: len(x) - (width - size)], x[width - size :])


def _blocks(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends of texts in them, row of each text, its offset in the row) with at most about BLOCK bytes."""
    row = 0
    for part in slices(texts, BLOCK):
        n = len(part)
        ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        if len(data) <= 2 * BLOCK:
            yield data, ends, np.arange(row, row + n), np.zeros(n, np.int64)
        else:
            for i in range(n):
                for s in range(0, max(1, ends[i + 1] - ends[i] - length + 1), BLOCK):
                    piece = data[ends[i] + s : min(ends[i + 1], ends[i] + s + BLOCK + length - 1)]
                    yield piece, np.array([0, len(piece)]), np.array([row + i]), np.array([s])
        row += n


def _keys(data: np.ndarray, ends: np.ndarray, length: int, common: Bloom | None, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None] | None:
    """(grams, each window's key, whether the window lies in one text, whether its key is another one because of common grams)."""
    if len(data) < length:
        return None
    g = _salted(data, salt)
    plain = _slide(g, length - GRAM + 1, np.minimum)
    key, other = plain, None
    if common is not None:
        g = g | (common.maybe(g).astype(_U) << _U(63))
        key = _slide(g, length - GRAM + 1, np.minimum)
        other = (key & ~_TOP) != plain
    inside = np.ones(len(data) + 1, bool)
    for e in ends[1:]:
        inside[max(0, e - length + 1) : e] = False
    return g, key, inside[: len(key)], other


def _key_counts(texts: DataFrame, length: int) -> DataFrame:
    """(h, n, gram): how often a key, or a gram of windows with a locally common key, is met; a row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met, held = [], []
            for data, ends, _, _ in _blocks(b.column(0), length):
                found = _keys(data, ends, length, None)
                if found is None:
                    met.append((np.zeros(0, _U), np.zeros(0, np.int64)))
                    continue
                g, key, inside, _ = found
                low = np.where(inside, key, _U(0))
                pad = np.zeros(length - GRAM, _U)
                chosen = _slide(np.concatenate((pad, low, pad)), length - GRAM + 1, np.maximum) == g
                met.append(np.unique(g[chosen], return_counts=True))
            h, at = np.unique(np.concatenate([*(x for x, _ in met), np.zeros(0, _U)]), return_inverse=True)
            common = h[np.bincount(at, np.concatenate([*(x for _, x in met), np.zeros(0, np.int64)]), len(h)) >= COMMON_LOCAL]
            for (data, ends, _, _), (own, _) in zip(_blocks(b.column(0), length) if len(common) else (), met, strict=False):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                if (common[at] == own).any():
                    g, key, inside, _ = _keys(data, ends, length, None)
                    at = np.minimum(np.searchsorted(common, key), len(common) - 1)
                    near = np.concatenate((inside & (common[at] == key), np.zeros(length - GRAM, bool)))
                    cover = np.cumsum(near)
                    cover = cover - np.concatenate((np.zeros(length - GRAM + 1, np.int64), cover[: -(length - GRAM + 1)]))
                    held.append(np.unique(g[cover > 0], return_counts=True))
            for kind, parts in ((False, met), (True, held)):
                h = np.concatenate([*(x for x, _ in parts), np.zeros(0, _U)])
                n = np.concatenate([*(x for _, x in parts), np.zeros(0, np.int64)])
                h, at = np.unique(h, return_inverse=True)
                n = np.bincount(at, n, len(h)).astype(np.int64)
                if kind:
                    h, n = h[n >= COMMON_LOCAL], n[n >= COMMON_LOCAL]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(np.full(len(h), kind))], ["h", "n", "gram"])

    return texts.mapInArrow(run, "h long, n long, gram boolean")


def _segments(docs: DataFrame, length: int, repeated: Bloom, common: Bloom | None, wanted: Bloom | None = None) -> DataFrame:
    """id, fp, start, h, digest, d (eight bytes of it), size, twice, other of each segment whose key may be met again.

    twice: its key stands in it more than once; other: some window has another key than what was counted. With wanted, a filter of d, only those that it lets through, and with their body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts_, keys, bodies, twices, others, size = [], [], [], [], [], [], 0

            def flush() -> pa.RecordBatch:
                at = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]))
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
                d = np.frombuffer(b"".join(digests), np.int64)[::2]
                names = ["id", "fp", "start", "h", "digest", "d", "size", "twice", "other", "body"]
                out = pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate([*starts_, np.zeros(0, np.int64)])), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])), pa.array(digests, pa.binary()), pa.array(d), pa.array([len(x) for x in bodies], pa.int32()), pa.array(twices, pa.bool_()), pa.array(np.concatenate([*others, np.zeros(0, bool)])), pa.array(bodies, pa.binary())],
                    names,
                )
                return out.select(names[:-1]) if wanted is None else out.filter(pa.array(wanted.maybe(np.ascontiguousarray(d))))

            for data, ends, row, offset in _blocks(b.column(2), length):
                found = _keys(data, ends, length, common)
                if found is None:
                    continue
                g, key, inside, other = found
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (inside[1:] != inside[:-1])
                new[ends[(ends > 0) & (ends < len(key))]] = True
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(key))
                ok = inside[first]
                passed = repeated.maybe(key[first] & ~_TOP)
                moved = np.zeros(len(first), bool)
                if other is not None:
                    # Such keys were not counted; let them pass.
                    upto = np.concatenate(([0], np.cumsum(other)))
                    moved = upto[last] > upto[first]
                ok &= passed | moved
                starts, stops, moved = first[ok], last[ok], moved[ok]
                pieces = -(-(stops - starts) // SEGMENT_WINDOWS)
                at = np.repeat(np.arange(len(starts)), pieces)
                step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                a = starts[at] + step * SEGMENT_WINDOWS
                z = np.minimum(a + SEGMENT_WINDOWS, stops[at])
                raw = data.tobytes()
                own = [raw[i : j + length - 1] for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                doc = np.searchsorted(ends, a, "right") - 1
                rows.append(row[doc])
                starts_.append(a - ends[doc] + offset[doc])
                keys.append(key[a].view(np.int64))
                others.append(moved[at])
                bodies += own
                # A window can repeat inside a segment only where the key stands in it twice.
                twices += [bool((g[i : j + length - GRAM] == key[i]).sum() > 1) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
                size += sum(map(len, own))
                if size >= HANDED_ON:
                    yield flush()
                    rows, starts_, keys, bodies, twices, others, size = [], [], [], [], [], [], 0
            yield flush()

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "fp", "text").mapInArrow(run, f"id {kind}, fp long, start long, h long, digest binary, d long, size int, twice boolean, other boolean" + ", body binary" * (wanted is not None))


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of strings joined by separators, with sampled run ends."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) for s in strings])
        self.ends = np.cumsum(lengths + 1) - 1  # places of the separators
        symbols = np.zeros(int(self.ends[-1]) + 1 + 8, np.uint16)
        body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        symbols[: len(body)] = body
        symbols[: len(body)] += 1
        symbols[self.ends] = 0
        self.symbols, self.n = symbols, len(body)
        order = self._suffixes()
        # Each separator differs from all else, so it always begins a run.
        before = symbols[np.where(order > 0, order - 1, self.n - 1)]
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        tail = np.append(head[1:], True)
        up, down = np.flatnonzero(head), np.flatnonzero(tail)
        self.above = self._samples(order, up, -1)
        self.below = self._samples(order, down, 1)
        # The runs: where they begin, their symbols, the text places of the suffixes at their ends; and the order of runs by symbol.
        self.begins, self.heads = up, before[up].astype(np.int64)
        self.top, self.bottom = order[up], order[down]
        lengths = down - up + 1
        self.by_symbol = np.argsort(self.heads, kind="stable")
        # A row with symbol c goes to the rows of suffixes that begin with c, in the same order: where each run's first row goes.
        self.goes = np.empty(len(up), np.int64)
        self.goes[self.by_symbol] = np.cumsum(lengths[self.by_symbol]) - lengths[self.by_symbol]

    @property
    def runs(self) -> int:
        return len(self.begins)

    def _suffixes(self) -> np.ndarray:
        """The suffix array, by prefix doubling from seven symbols; only undecided suffixes are sorted again."""
        n, s = self.n, self.symbols.astype(_U)
        key, open_ = np.zeros(n, _U), np.ones(n, bool)
        for i in range(7):
            part = np.where(open_, s[i : i + n], _U(0))
            key = key << _U(9) | part
            open_ &= part != 0
        order = np.argsort(key)
        sorted_key = key[order]
        # Suffixes that reach a separator within the key stand in the order of their places.
        short = np.flatnonzero(~open_[order])
        own = order[short]
        order[short] = own[np.lexsort((own, key[own]))]
        # Suffixes that reach a separator within the key are decided by its place, as they stand now.
        new = np.ones(n, bool)
        new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_[order][1:]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        size = 7
        while True:
            tied = ~new
            tied[:-1] |= ~new[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                return order
            own = order[at]
            base = rank[own]
            nxt = own + size
            second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], 0)
            again = np.argsort(base.astype(_U) << _U(32) | second.astype(_U))
            order[at] = own[again]
            base, second = base[again], second[again]
            new[at] = True
            same = (base[1:] == base[:-1]) & (second[1:] == second[:-1])
            new[at[1:][same]] = False
            rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
            size *= 2

    def _samples(self, order: np.ndarray, rows: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(text positions, ascending, and the length that each shares with its neighbour) of sampled rows."""
        other = rows + step
        ok = (other >= 0) & (other < self.n)
        here, there = order[rows], order[np.clip(other, 0, self.n - 1)]
        shared = np.zeros(len(rows), np.int64)
        active = np.flatnonzero(ok)
        words = np.zeros(len(self.symbols) - 3, _U)
        for i in range(4):
            words |= self.symbols[i : len(words) + i].astype(_U) << _U(16 * i)
        while len(active):
            p, q = here[active] + shared[active], there[active] + shared[active]
            x = words[p] ^ words[q]
            equal = np.zeros(len(active), np.int64)
            going = np.ones(len(active), bool)
            for i in range(4):
                going &= ((x >> _U(16 * i)) & _U(0xFFFF) == 0) & (self.symbols[p + i] != 0)
                equal += going
            shared[active] += equal
            active = active[going]
        by = np.argsort(here)
        return here[by], shared[by]

    def matching_statistics(self) -> np.ndarray:
        """At each position, the length of the longest match that starts anywhere else."""
        best = np.zeros(self.n, np.int64)
        for places, shared in (self.above, self.below):
            # From a sample on, length + place stays the same; before the first one there is no match.
            reach = np.zeros(self.n, np.int64)
            ends = shared + places
            reach[places] = np.diff(ends, prepend=0)
            np.maximum(best, np.cumsum(reach) - np.arange(self.n), out=best)
        return best


    def _shared(self, p: int, q: int) -> int:
        """How many symbols the suffixes at p and q share; a separator ends them."""
        n, step = 0, 16
        while True:
            x, y = self.symbols[p + n : min(self.n, p + n + step)], self.symbols[q + n : min(self.n, q + n + step)]
            k = min(len(x), len(y))
            differ = np.flatnonzero((x[:k] != y[:k]) | (x[:k] == 0))
            if len(differ):
                return n + int(differ[0])
            n += k
            if k < step:
                return n
            step *= 2

    def statistics_of(self, text: bytes) -> np.ndarray:
        """At each position of a text that is not in the index, the length of the longest match in it, streamed from the end.

        One step back costs a search among the runs: where the row's run has the wanted symbol the match grows by
        one; else the row moves to the nearer run of that symbol, above or below, with which it shares more, by the
        sampled place of that run's end.
        """
        out = np.zeros(len(text), np.int64)
        row, place, length = 0, int(self.top[0]), 0
        marks = np.searchsorted(self.heads[self.by_symbol], np.arange(258))
        for i in range(len(text) - 1, -1, -1):
            c = text[i] + 1
            own = self.by_symbol[marks[c] : marks[c + 1]]
            if not len(own):
                length, row, place = 0, 0, int(self.top[0])
                continue
            run = int(np.searchsorted(self.begins, row, "right")) - 1
            if self.heads[run] != c:
                at = int(np.searchsorted(own, run))
                tries = []
                if at > 0:
                    above = int(own[at - 1])
                    tries.append((min(length, self._shared(place, int(self.bottom[above]))) if length else 0, above, int(self.bottom[above]), int(self.begins[above + 1]) - 1 if above + 1 < len(self.begins) else self.n - 1))
                if at < len(own):
                    below = int(own[at])
                    tries.append((min(length, self._shared(place, int(self.top[below]))) if length else 0, below, int(self.top[below]), int(self.begins[below])))
                length, run, place, row = max(tries)
            row = int(self.goes[run]) + row - int(self.begins[run])
            place -= 1
            length += 1
            out[i] = length
        return out


def repeated_windows(strings: list[bytes], length: int) -> list[list[int]]:
    """For each string, the windows in it that occur elsewhere in the strings, as flat [from, to) pairs."""
    if not strings:
        return []
    index = RunLengthIndex(strings)
    hit = np.append(index.matching_statistics() >= length, False).astype(np.int8)
    edge = np.diff(hit, prepend=np.int8(0))
    begins, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    which = np.searchsorted(index.ends, begins)
    base = np.append(0, index.ends[:-1] + 1)
    out: list[list[int]] = [[] for _ in strings]
    for w, b, e in zip(which.tolist(), begins.tolist(), stops.tolist(), strict=True):
        out[w] += [b - int(base[w]), e - int(base[w])]
    return out


def _by_index(table: pa.Table, length: int) -> pa.Table:
    rows = table.sort_by("digest")
    found = repeated_windows(rows["body"].to_pylist(), length)
    keep = [i for i, x in enumerate(found) if x]
    return pa.table({"digest": rows["digest"].take(pa.array(keep, pa.int64())), "hits": pa.array([found[i] for i in keep], pa.list_(pa.int32()))})


def _sub_grams(big: DataFrame, length: int, salt: int) -> DataFrame:
    """h: grams that are met in over COMMON segments, or as often in them, of one large key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = []
            for at in range(0, len(b), 256):
                grams = [_salted(np.frombuffer(x, np.uint8), salt) for x in b.column(0).slice(at, 256).to_pylist()]
                met.append(np.unique(np.concatenate(grams), return_counts=True))
            h = np.concatenate([*(x for x, _ in met), np.zeros(0, _U)])
            n = np.concatenate([*(x for _, x in met), np.zeros(0, np.int64)])
            h, at = np.unique(h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(at, n, len(h)).astype(np.int64))], ["h", "n"])

    return big.select("body").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)


def _by_new_keys(big: DataFrame, length: int, shard_bytes: int, salt: int = 0x5BD1E995) -> DataFrame:
    """(digest, hits) of segments (h, digest, body; all distinct) of keys that would make too large an index: they are cut again by other keys.

    Among them, grams met COMMON times or more lose against others, so a window with any rarer gram has a key with few
    segments. What has none is indexed in parts of half of KEY_BYTES, each pair of parts by a task of its own.
    """
    grams = written(_sub_grams(big, length, salt), "sub-grams")
    count = grams.count()
    common = bloom(grams, "h", count) if count else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.slice(s, 256)
                of, begin, keys, bodies = [], [], [], []
                for i, (h, x) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    data = np.frombuffer(x, np.uint8)
                    _, key, _, _ = _keys(data, np.array([0, len(data)]), length, common, salt)
                    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    last = np.append(first[1:], len(key))
                    of += [i] * len(first)
                    begin += first.tolist()
                    keys += (_mix(key[first] ^ _U(h & 0xFFFFFFFFFFFFFFFF))).view(np.int64).tolist()
                    bodies += [x[a : z + length - 1] for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                digests = [hashlib.blake2b(x, digest_size=16).digest() for x in bodies]
                names = ["parent", "begin", "h", "digest", "body"]
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(of, pa.int64())), pa.array(begin, pa.int32()), pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], names)

    cut = written(big.select("h", "digest", "body").mapInArrow(run, "parent binary, begin int, h long, digest binary, body binary"), "sub-segments")
    distinct = written(cut.groupBy("h", "digest").agg(F.count("*").alias("w"), F.first("body").alias("body")), "sub-distinct")
    per = written(distinct.groupBy("h").agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("k")), "sub-keys")
    sized = written(lookup_join(distinct, per, "h", "k", "inner"), "sub-sized")
    total = per.filter(F.col("bytes") <= KEY_BYTES).agg(F.sum("bytes")).first()[0] or 0
    small = sized.filter(F.col("bytes") <= KEY_BYTES).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(total // shard_bytes + 1)))
    found = small.select("shard", "digest", "body").groupBy("shard").applyInArrow(lambda t: _by_index(t, length), "digest binary, hits array<int>")
    large = sized.filter(F.col("bytes") > KEY_BYTES)
    if large.head(1):
        parts = F.ceil(2 * F.col("bytes") / KEY_BYTES).cast("int")
        own = large.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
        # A part meets each other one, and with two parts or more all of its strings meet each other there as well.
        pairs = own.withColumn("o", F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("p"))))
        pairs = pairs.select("h", F.least("p", "o").alias("a"), F.greatest("p", "o").alias("b"), "digest", "body")
        found = found.unionByName(pairs.groupBy("h", "a", "b").applyInArrow(lambda t: _by_index(t, length), "digest binary, hits array<int>"))
    found = written(found.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits")), "sub-hits")
    often = distinct.filter("w > 1").select("digest", F.array(F.lit(0), (F.octet_length("body") - length + 1).cast("int")).alias("all"), "w")
    marks = often.join(found, "digest", "full").select("digest", F.coalesce("all", "hits").alias("hits"), F.coalesce("w", F.lit(1)).alias("w"))
    here = lookup_join(cut.select("parent", "begin", "digest"), written(marks, "sub-marked"), "digest", "w", "inner")
    moved = here.select(F.col("parent").alias("digest"), F.transform("hits", lambda x: x + F.col("begin")).alias("hits"))
    return moved.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def repeated_spans(df: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, fp (xxhash64 of the text), spans: per text with any, the byte ranges covered by strings of `length` bytes that also start elsewhere.

    spans is a flat, unsorted array of [from, to) pairs, which may overlap. df is read three times.
    """
    docs = df.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text")).filter(F.octet_length("text") >= length)
    counts = _key_counts(docs.select("text"), length).repartition("h").groupBy("h", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts.filter(F.when(F.col("gram"), F.col("n") >= COMMON).otherwise(F.col("n") > 1)), "keys")
    keys, grams = counts.filter("not gram"), counts.filter("gram")
    n_grams = grams.count()
    n_keys = keys.count()
    repeated, common = bloom(keys, "h", n_keys), bloom(grams, "h", n_grams) if n_grams else None
    segments = _segments(docs, length, repeated, common)
    if not repeated.suits(n_keys):
        # More keys than a filter tells apart: what it let through is looked up among them; segments with keys that were not counted stay.
        again_ = written(segments.withColumn("counted", ~F.col("other")), "all-segments")
        plain = F.col("h").bitwiseAND(F.lit((1 << 63) - 1))
        met = lookup_join(again_.filter("counted").withColumn("plain", plain), keys.select(F.col("h").alias("plain"), "n"), "plain", "n", "inner").drop("plain")
        segments = met.unionByName(again_.filter("not counted"))
    segments = written(segments.select("id", "fp", "start", "h", "digest", "d", "size", "twice"), "segments")
    discard(counts)
    distinct = written(segments.groupBy("h", "digest", "d", "size", "twice").agg(F.count("*").alias("w")), "distinct")
    # Only keys with a segment of which nothing is known yet need an index.
    per = distinct.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("k"), F.sum(F.when(F.col("w") == 1, 1).otherwise(0)).alias("single"), F.max("twice").alias("inner_"))
    per = written(per.filter("single > 0 and (k > 1 or inner_)").select("h", "bytes", "k"), "to-index")
    total = per.filter(F.col("bytes") <= KEY_BYTES).agg(F.sum("bytes")).first()[0] or 0
    shards = total // SHARD_BYTES + 1
    todo = written(lookup_join(distinct.select("h", "digest", "d"), per, "h", "k", "inner"), "to-read")
    # Their texts are read again: a third pass, instead of keeping the texts of all segments.
    texts = _segments(docs, length, repeated, common, bloom(todo, "d", todo.count())).groupBy("h", "digest", "body").agg(F.count("*").alias("w"))
    texts = written(lookup_join(written(texts, "texts"), per, "h", "k", "inner"), "texts-to-index")
    give_back(df.sparkSession)
    small = texts.filter(F.col("bytes") <= KEY_BYTES).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    found = small.select("shard", "digest", "body").groupBy("shard").applyInArrow(lambda t: _by_index(t, length), "digest binary, hits array<int>")
    if per.filter(F.col("bytes") > KEY_BYTES).head(1):
        found = found.unionByName(_by_new_keys(texts.filter(F.col("bytes") > KEY_BYTES).select("h", "digest", "body"), length, SHARD_BYTES))
    single = distinct.filter("w = 1").select("digest", "w")
    found = written(found, "hits")
    discard(texts, todo, per)
    all_of = distinct.filter("w > 1").select("digest", F.array(F.lit(0), (F.col("size") - length + 1).cast("int")).alias("hits"), "w")
    hits = written(all_of.unionByName(single.join(found, "digest").select("digest", "hits", "w")), "marked")
    here = lookup_join(segments.select("id", "fp", "start", "digest"), hits, "digest", "w", "inner")
    pairs = F.transform(F.col("hits"), lambda x, i: F.col("start") + x + F.when(i % 2 == 1, F.lit(length - 1)).otherwise(F.lit(0)))
    return here.select("id", "fp", pairs.alias("spans")).groupBy("id", "fp").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans.reshape(-1, 2).tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(df: DataFrame, length: int, text: str, key: str) -> DataFrame:
    """df with __kept (binary), __removed (array of [from, to) byte ranges, merged)."""
    spans = written(repeated_spans(df, length, text, key), "spans")
    give_back(df.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.withColumn("__id", F.col(key)).withColumn("__fp", F.xxhash64(body))
    some = bloom(spans.select(F.xxhash64("id", "fp").alias("h")), "h", spans.count())
    source = source.withColumn("__maybe", some.holds(F.xxhash64("__id", "__fp")))
    ranges = "array<struct<from:long,to:long>>"
    clear = source.filter("not __maybe").withColumn("__kept", body.cast("binary")).withColumn("__removed", F.array().cast(ranges))

    @F.arrow_udf(f"struct<kept:binary,removed:{ranges}>")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, lists, strict=True):
            raw = (t.as_py() or "").encode()
            runs = merged(s.values.to_numpy()) if s.is_valid else []
            at, kept = 0, []
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            out.append({"kept": b"".join([*kept, raw[at:]]), "removed": [{"from": a, "to": b} for a, b in runs]})
        return pa.array(out, pa.struct([("kept", pa.binary()), ("removed", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))]))

    met = source.filter("__maybe").join(spans.withColumnsRenamed({"id": "__of", "fp": "__print", "spans": "__spans"}), F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__fp") == F.col("__print")), "left")
    met = met.withColumn("__cut", cut(F.col(text), F.col("__spans"))).withColumn("__kept", F.col("__cut.kept")).withColumn("__removed", F.col("__cut.removed"))
    columns = [*df.columns, "__kept", "__removed"]
    return clear.select(columns).unionByName(met.select(columns))


def remove_repeats(df: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with kept (binary: the bytes that stay), removed (array of [from, to) byte ranges, merged) and n_bytes; columns of these names are replaced.

    Removed is each byte covered by a string of `length` bytes that also starts elsewhere in any text,
    the same one included. Null texts count as empty; shorter texts stay whole; a repeated row is a text
    of its own. Keys may repeat or be null. An empty table gives no rows. df is read five times.
    """
    cut = _cut(df.drop("kept", "removed", "n_bytes"), length, text, key)
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return cut.withColumnsRenamed({"__kept": "kept", "__removed": "removed"}).withColumn("n_bytes", size)


def strip_repeats(df: DataFrame, length: int = 200, text: str = "text", key: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """df, all rows and columns, with repeated bytes gone from the text and the text's length in size (if df has it).

    A character of which only a part was covered goes whole. Texts without repeats stay as they are, nulls too;
    so do all other columns, whatever their names.
    """

    @F.arrow_udf("string")
    def characters(raw: pa.Array) -> pa.Array:
        return pa.array([x.decode("utf-8", "ignore") for x in raw.to_pylist()], pa.string())

    cut = _cut(df, length, text, key)
    less = F.size("__removed") > 0
    out = cut.withColumn("__text", characters(F.when(less, F.col("__kept")).otherwise(F.lit(b"")))).withColumn(text, F.when(less, F.col("__text")).otherwise(F.col(text)))
    if size in df.columns:
        out = out.withColumn(size, F.when(less, F.length(text)).otherwise(F.col(size)).cast(df.schema[size].dataType))
    return out.select(df.columns)
