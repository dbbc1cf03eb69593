"""Near duplicates: a Jaccard self-join of word 5-shingle sets by PartEnum signatures, then components.

Sets are put into size bands of ratio 1/similarity. Sets as similar as asked for lie in one band or in
neighbouring ones, and their symmetric difference has at most k elements, k following from the sizes.
The domain of shingles is cut into n1 partitions of n2 parts each by hashes; with more than
k / (k2 + 1) partitions, at least one differs in at most k2 elements, so its parts agree in some subset
of n2 - k2 parts: each such subset's content is a signature. Two similar sets share one; a set gets
signatures for its own band and, as the larger of a pair, for the band below.

Beforehand: equal sets are joined into one by their digests; and sets of which more than a fifth of
their elements are held by no other set can have no partner. That is found from a fixed share of the
domain (over a fifth, so that it can tell), counted over all texts, with a Bloom filter of repeated
shingles that may pass more sets but never fewer.

Candidates: a signature's sets are compared with its smallest and largest member first; components of
what links so far; then, for each signature of several components, its members outside the largest one
are compared with its other members, by size band and in blocks. So no link between components is lost, and a large
group of near copies does not become rows of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bloom import Bloom, bloom, without
from quire.llm.chunked import slices
from quire.llm.common import again, discard, drop, give_back, lookup_join, numbered, written

WORDS = 5
#: Bytes of texts, and of a long text, that are hashed at once; arrays of sixteen words for each byte are held meanwhile.
SLICE, STRETCH = 512 << 10, 1 << 20
#: The share of the domain looked at for the first sieve; it must be over 1 - similarity.
SIEVE = 0.28
#: Pairs that one copy of a hub's set is compared with, about.
HUB_PAIRS = 2000
#: Sets in a block, about, when a component is compared with what stands beside it.
BLOCK = 512

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=_U) + _U(seed)) * _U(0x9E3779B97F4A7C15))


@lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD6E8FEB86659FD93 | 1, _U), dtype=_U)


_BYTES, _PLACES = _stream(11, 256), _stream(12, WORDS)


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each shingle occurrence: A-Z lower-cased, words split at white space of ASCII. Fewer words than asked for are one shingle."""
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = raw[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True
    begins = ~white
    begins[1:] &= white[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    doc = np.searchsorted(ends, starts, "right") - 1
    inside = np.flatnonzero(~white)
    word = np.cumsum(begins)[inside] - 1
    at = inside - starts[word]
    power = _powers(1 << int(at.max() + 1).bit_length())
    value = _mix(np.add.reduceat(_BYTES[data[inside]] * power[at], np.searchsorted(inside, starts)) + np.bincount(word, minlength=len(starts)).astype(_U))
    count = np.bincount(doc, minlength=n)
    total = np.zeros(len(value), _U)
    left = np.cumsum(count)[doc] - np.arange(len(value))  # words from here to the document's end
    for i in range(words):
        if i < len(value):
            total[: len(value) - i] += np.where(left[: len(value) - i] > i, value[i:] * _PLACES[i % WORDS], _U(0))
    whole = left >= words
    short = (count < words)[doc] & (left == count[doc])
    size = np.minimum(count[doc], words).astype(_U)
    keep = whole | short
    return doc[keep], _mix(total + size)[keep]


def _stretches(text: bytes, words: int = WORDS) -> Iterator[bytes]:
    """A long text in stretches of about STRETCH bytes, or a longer word, which hold all its shingles: each goes on for words - 1 words of the next."""
    data = np.frombuffer(text, np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    del white
    if len(starts) <= 2 * words:
        yield text
        return
    at = 0
    while at < len(starts):
        to = max(at + words, int(np.searchsorted(starts, starts[at] + STRETCH)))
        if to + words > len(starts):
            to = len(starts)
        last = to + words - 1
        yield text[starts[at] : starts[last] if last < len(starts) else len(text)]
        at = to


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By slices: (offsets of the documents, their distinct shingles in ascending order). A text of over 2 * STRETCH bytes is a slice of its own, hashed in stretches."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    long = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 2 * STRETCH).tolist()
    for a, b in zip([-1, *long], [*long, len(texts)], strict=True):
        if a >= 0:
            h = np.zeros(0, _U)
            for stretch in _stretches(texts[a].as_buffer().to_pybytes()):
                # A stretch is no text of its own: its bytes may be of any kind, and its first and last words are whole.
                part = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(stretch)], np.int64)), pa.py_buffer(stretch)])
                h = np.union1d(h, shingles(part)[1])
            yield np.array([0, len(h)]), h
        if b > a + 1:
            yield from _short_sets(texts.slice(a + 1, b - a - 1))


def _short_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for part in slices(texts, SLICE):
        doc, h = shingles(part)
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        yield np.searchsorted(doc, np.arange(len(part) + 1)), h


def _in_sieve(h: np.ndarray) -> np.ndarray:
    return h < _U(int(SIEVE * 2**64))


def _repeated(texts: DataFrame) -> Bloom:
    """A filter of the sieve's shingles that several texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [h[_in_sieve(h)] for _, h in shingle_sets(b.column(0))]
            h, n = np.unique(np.concatenate([*found, np.zeros(0, _U)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    # A batch gives a shingle once, so no key has many rows; dealt out first, else each task would also keep all of its own in a hash table.
    met = texts.mapInArrow(run, "h long, n byte").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    met = written(met, "repeated")
    found = bloom(met, "h", met.count())
    discard(met)
    return found


def _sets(df: DataFrame, repeated: Bloom, percent: int) -> DataFrame:
    """id, n_shingles; digest and shingles (sorted 64-bit hashes) where the sieve lets the set through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            sizes, digests, bodies = [], [], []
            for upto, h in shingle_sets(b.column(1)):
                alone = _in_sieve(h)
                alone[alone] = ~repeated.maybe(h[alone])
                before = np.concatenate(([0], np.cumsum(alone)))
                n, lone = np.diff(upto), before[upto[1:]] - before[upto[:-1]]
                open_ = (n > 0) & (100 * lone <= (100 - percent) * n)
                for i, (a, z) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)):
                    body = h[a:z].tobytes() if open_[i] else None
                    bodies.append(body)
                    digests.append(body and hashlib.blake2b(body, digest_size=16).digest())
                sizes.append(n)
            n = np.concatenate([*sizes, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["id", "n_shingles", "digest", "shingles"])

    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, n_shingles long, digest binary, shingles binary")


def band_of(n: int, percent: int) -> int:
    """Band j holds the sizes n with edges[j] <= n < edges[j + 1]; sets as similar as asked for lie in one band or in neighbouring ones."""
    return int(np.searchsorted(_edges(percent), n, "right")) - 1


@lru_cache(4)
def _edges(percent: int) -> np.ndarray:
    # The smallest size of the next band is over what the smallest of this one may be linked with.
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges)


def plan(band: int, percent: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare) for pairs whose smaller set is in this band: at least 1 + spare of the n1 partitions differ in at most k2 elements."""
    small = int(_edges(percent)[band + 1]) - 1
    large = 100 * small // percent
    k = (100 - percent) * (small + large) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    k2, n2 = (1, 3) if k <= 24 else (0, 1)
    least = k // (k2 + 1)
    spare = 1 + (-(-least // 16))
    return least + 1 + spare, n2, k2, spare


def signatures(body: np.ndarray, percent: int) -> np.ndarray:
    """Those of one set, over both bands and all partitions, distinct."""
    own = band_of(len(body), percent)
    out = []
    for band in (own, own - 1):
        if band < 0:
            continue
        n1, n2, k2, spare = plan(band, percent)
        place = _mix(body + _U(0x1234567 + 7 * band))
        part = (place >> _U(40)) % _U(n1)
        sub = (place & _U(0xFFFF)) % _U(n2)
        value = _mix(place + _U(0x51ED270B))
        cell = (part * _U(n2) + sub).astype(np.int64)
        hashes, held = np.zeros(n1 * n2, _U), np.bincount(cell, minlength=n1 * n2)
        np.add.at(hashes, cell, value)
        hashes, held = hashes.reshape(n1, n2), held.reshape(n1, n2)
        # With n2 - k2 = n2 - 1 parts in a subset, a subset leaves one part out; with k2 = 0 it has all.
        if k2:
            content, filled = hashes.sum(1)[:, None] - hashes, held.sum(1)[:, None] - held
        else:
            content, filled = hashes.sum(1)[:, None], held.sum(1)[:, None]
        where = (np.arange(content.size, dtype=_U) + _U(band << 32)).reshape(content.shape)
        sig = _mix(_mix(where) + _mix(content + filled.astype(_U)))
        bare = filled == 0
        # Partitions with an empty subset need no signature there while they are fewer than those that must agree.
        if bare.any(1).sum() <= spare:
            out.append(sig[~bare])
        else:
            out.append(sig.ravel())
    return np.unique(np.concatenate(out))


def _signed(reps: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signatures(np.frombuffer(x, _U), percent) for x in b.column(1).to_pylist()]
            row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            sig = np.concatenate([*found, np.zeros(0, _U)])
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), b.column(0).take(pa.array(row))], ["sig", "id"])

    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "shingles").mapInArrow(run, f"sig long, id {kind}")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b), distinct, whose sets (id, shingles) are similar. A hub a of many pairs is dealt out in copies of its set."""
    hubs = pairs.groupBy("a").agg(F.count("*").alias("w")).withColumn("copies", (F.col("w") / HUB_PAIRS).cast("int") + 1)
    hubs = written(hubs, "hubs")
    salted = lookup_join(pairs, hubs, "a", "w", "inner").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies").cast("long")))
    members = salted.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    copies = hubs.join(sets.withColumnRenamed("id", "a"), "a").select("a", F.col("shingles").alias("sa"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("salt"))

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            u, v = np.frombuffer(p.as_py(), _U), np.frombuffer(q.as_py(), _U)
            if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                out.append(False)
                continue
            both = np.sort(np.concatenate((u, v)))
            same = int((both[1:] == both[:-1]).sum())
            out.append(100 * same >= percent * (len(both) - same))
        return pa.array(out, pa.bool_())

    return members.join(copies.hint("shuffle_merge"), ["a", "salt"]).filter(similar("sa", "sb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id) of every end of links (a, b), by alternating large and small stars until nothing changes; each round is written out.

    The number of rounds grows with the logarithm of the longest chain.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours of a vertex point to its smallest neighbour or itself
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("w")), "least")
        large = lookup_join(both, least, "a", "w", "inner").filter("b > a").select(F.col("m").alias("a"), "b").distinct()
        # small star: smaller neighbours of a vertex, and itself, point to the smallest of them
        down = written(large, "large")
        root = written(down.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("w")), "root")
        small = lookup_join(down, root, "b", "w", "inner")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        after = written(small, "edges")
        drop(edges, least, down, root)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component"))).distinct()


def near_duplicates(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of df: key, n_shingles, component_id (the smallest key reachable over links, its own included).

    Two texts link where 100 * |A and B| >= percent * |A or B| for their sets of 5-word shingles; percent
    is from 75 to 100. Null and wordless texts have empty sets and link with nothing. Rows that repeat a
    key count as different texts of the same name. Rows without a key link like any other, but their component is
    null where no text with a key is linked with them. An empty table gives no rows. Shingles are compared by
    64-bit hashes. df is read twice.
    """
    if not 100 * (1 - SIEVE) < percent <= 100:
        raise ValueError("percent is out of range")
    if df.filter(F.col(key).isNull()).head(1):
        rows = numbered(df.select(F.col(key).alias("__key"), F.col(text).alias("text")), "__key", "text")
        own = near_duplicates(rows, percent, "text", "__row")
        # Numbers go up with the keys and nulls come last, so a component's first number belongs to its smallest key.
        names = rows.select(F.col("__row").alias("component_id"), F.col("__key").alias("__name"))
        own = own.join(rows.select("__row", "__key"), "__row").join(names, "component_id", "left")
        return own.select(F.col("__key").alias(key), "n_shingles", F.col("__name").alias("component_id"))
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    sets = written(_sets(docs, _repeated(docs.select("text")), percent), "sets")
    groups = written(sets.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "set-groups")
    first = groups.select(F.col("rep").alias("id"), "digest")
    reps = written(sets.join(first, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "n_shingles", "shingles"), "reps")
    whole, sets = sets, written(sets.select("id", "n_shingles", "digest"), "set-sizes")
    discard(whole)
    signed = written(_signed(reps, percent), "signatures")
    buckets = written(signed.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("w")).filter("lo != hi"), "buckets")
    met = written(lookup_join(signed, buckets, "sig", "w", "inner"), "met")
    discard(signed, buckets)
    hubs = met.select("id", F.explode(F.array("lo", "hi")).alias("hub")).filter("hub != id")
    pairs = written(hubs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = written(_linked(pairs, reps, percent), "links")
    give_back(df.sparkSession)
    found = written(components(links), "components")

    # What shares a signature but not a component yet: per signature all but its largest component, against that and each other.
    placed = written(met.select("sig", "id").join(found, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("c")), "placed")
    discard(met, pairs)
    parts = placed.groupBy("sig", "c").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("sig").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max("k").alias("k"), F.sum("k").alias("w")).filter("c1 != c2")
    mixed = written(mixed.select("sig", "k", "w"), "mixed")
    largest = lookup_join(parts.withColumnRenamed("k", "own"), mixed.drop("w"), "sig", "k", "inner", weighted=True).filter("own = k")
    top = written(largest.groupBy("sig").agg(F.max("c").alias("top")).join(mixed.select("sig", "w"), "sig"), "top")
    sides = written(lookup_join(placed, top, "sig", "w", "inner").select("top", "id", "c").distinct(), "sides")
    discard(placed, mixed, top)
    if sides.head(1):
        extra = written(_compared(sides, reps, percent), "more-links")
        if extra.head(1):
            found = written(components(links.unionByName(extra)), "components")

    of = groups.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("digest", "w", F.coalesce("component", "rep").alias("component_id"))
    out = lookup_join(sets.select("id", "n_shingles", "digest"), written(of, "set-components"), "digest", "w")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def _bands(n: Column, percent: int) -> Column:
    """The band of a size, as a column."""
    edges = [int(e) for e in _edges(percent)]
    return F.aggregate(F.array(*(F.lit(e) for e in edges)), F.lit(-1), lambda j, e: j + (n >= e).cast("int"))


def _compared(sides: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links of sets that share a signature of several components: (top, id, c), top being the signature's largest component and c the set's own.

    The members of other components (odd ones) are compared with all; one link for each member and component. Only sets
    of one band or of neighbouring ones meet, in blocks of about BLOCK sets, so no task has a whole component and no
    pair becomes a row. In a block, a set is compared with those that it shares shingles with.
    """
    banded = sides.join(reps.select("id", _bands(F.floor(F.octet_length("shingles") / 8), percent).alias("band")), "id")
    xs_ = banded.filter("c != top").withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    xs_ = written(xs_.select("top", "id", "c", "band"), "odd-sides")
    ys_ = written(banded.join(xs_.select("top", "band").distinct(), ["top", "band"], "left_semi").select("top", "id", "c", "band"), "all-sides")
    nx = xs_.groupBy("top", "band").agg(F.count("*").alias("x"))
    ny = ys_.groupBy("top", "band").agg(F.count("*").alias("y"))
    many = nx.join(ny, ["top", "band"]).select(F.struct("top", "band").alias("g"), (F.col("x") / BLOCK).cast("int").alias("xs"), (F.col("y") / BLOCK).cast("int").alias("ys"), (F.col("x") + F.col("y")).alias("w"))
    many = written(many, "blocks")

    def side(df: DataFrame, own: str, other: str, name: str, far: str) -> DataFrame:
        body = again(reps).select("id", "shingles")
        grouped = again(df).select(F.struct("top", "band").alias("g"), "id", "c")
        met = lookup_join(grouped, again(many), "g", "w", "inner").withColumn(name, F.pmod(F.xxhash64("id"), F.col(own) + 1).cast("int"))
        return met.withColumn(far, F.explode(F.sequence(F.lit(0), F.col(other)))).select("g", "xb", "yb", "id", "c").join(body, "id").groupBy("g", "xb", "yb")

    def compare(xs: pa.Table, ys: pa.Table) -> pa.Table:
        kind = xs.schema.field("id").type if len(xs) else ys.schema.field("id").type
        a, b = [], []
        if len(xs) and len(ys):
            sets = [np.frombuffer(y, _U) for y in ys["shingles"].to_pylist()]
            lengths = np.array([len(y) for y in sets])
            words, code = np.unique(np.concatenate(sets), return_inverse=True)
            # Which sets hold each shingle: those of shingle w stand in owner[first[w] : first[w + 1]].
            by = np.argsort(code, kind="stable")
            owner = np.repeat(np.arange(len(sets)), lengths)[by]
            first = np.searchsorted(code[by], np.arange(len(words) + 1))
            ids, homes = ys["id"].to_pylist(), ys["c"].to_pylist()
            for x, i, c in zip(xs["shingles"].to_pylist(), xs["id"].to_pylist(), xs["c"].to_pylist(), strict=True):
                own = np.frombuffer(x, _U)
                at = np.minimum(np.searchsorted(words, own), len(words) - 1)
                at = at[words[at] == own]
                n = first[at + 1] - first[at]
                held = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                same = np.bincount(owner[held], minlength=len(sets))
                seen = set()
                for j in np.flatnonzero((same > 0) & (100 * same >= percent * (len(own) + lengths - same))).tolist():
                    if homes[j] != c and homes[j] not in seen:
                        seen.add(homes[j])
                        a.append(i)
                        b.append(ids[j])
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    kind = reps.schema["id"].dataType.simpleString()
    return side(xs_, "xs", "ys", "xb", "yb").cogroup(side(ys_, "ys", "xs", "yb", "xb")).applyInArrow(compare, f"a {kind}, b {kind}")


def near_dedup(df: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's rows of which one of each group of near duplicates stays: the one with the smallest key (null last); with all columns.

    Rows that share a key, or have none, are texts of their own.
    """
    rows = numbered(df, key, text)
    if rows is not None:
        return near_dedup(rows, percent, text, "__row").drop("__row")
    dropped = written(near_duplicates(df, percent, text, key).filter(F.col(key) != F.col("component_id")).select(key), "dropped")
    give_back(df.sparkSession)
    return without(df, dropped, key)
