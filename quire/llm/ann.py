"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one more coordinate, so that all have the length of the longest and the nearest by
distance are the largest by inner product. Centroids are fitted on a bounded sample with a penalty for
full clusters; each vector goes to the list of its nearest centroid and, near a boundary, to lists of
further ones, unless those lie on the same side. Centroids are searched by a neighbour graph held in
memory. A query looks at the lists whose centroid is at most (1 + slack) times as far as the nearest one;
slack is the least with which queries from the sample find RECALL of their neighbours in it.

Equal vectors are searched once. Lists of neighbouring centroids are searched together, in blocks, each of
which hands on its k + 1 nearest of a query only; long lists, and blocks that many queries look at, are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import lookup_join, written

#: Vectors in a list, about; the number of lists stops at MOST_LISTS, so what holds the centroids is bounded.
LIST_SIZE, MOST_LISTS = 512, 4096
#: Coordinates in the sample that centroids are fitted on, at most: 20,000 vectors of 64.
SAMPLE_COORDINATES = 20_000 * 64
#: Share of sampled queries' neighbours that the chosen slack finds.
RECALL = 0.97
#: Lists that a boundary vector is in at most, and how much farther their centroids may be.
REPLICAS, BOUNDARY = 4, 0.15
#: Vectors in a block of neighbouring lists, or of one long list, about; and half of the probes of a block.
BLOCK = 16_384
#: Scores that are held at once.
SCORES = 4 << 20
DEGREE, LEAST_LISTS = 24, 4


@dataclass
class CentroidGraph:
    """Centroids, each with its nearest neighbours and one of a ring, so that all can be reached."""

    centroids: np.ndarray
    edges: np.ndarray
    slack: float = 0.0

    @staticmethod
    def of(centroids: np.ndarray) -> CentroidGraph:
        n = len(centroids)
        d = ((centroids**2).sum(1)[None] - 2 * centroids @ centroids.T) + (centroids**2).sum(1)[:, None]
        near = np.argsort(d, 1, kind="stable")[:, 1 : DEGREE + 1]
        return CentroidGraph(centroids, np.concatenate((near, ((np.arange(n) + 1) % n)[:, None]), 1))

    def search(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the `most` nearest found for each row of x, nearest first, by beam search in all rows at once."""
        n, rows = len(self.centroids), np.arange(len(x))[:, None]
        most = min(most, n)
        beam = min(n, most + DEGREE)
        norms = (self.centroids**2).sum(1)

        def far(ids: np.ndarray) -> np.ndarray:
            return norms[ids] - 2 * np.einsum("bd,bkd->bk", x, self.centroids[ids]) + (x**2).sum(1)[:, None]

        begin = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(int))
        ids = np.repeat(begin[None], len(x), 0)
        dist, done = far(ids), np.zeros(ids.shape, bool)
        seen = np.zeros((len(x), n), bool)
        seen[rows, ids] = True
        while True:
            open_ = np.where(done, np.inf, dist)
            best = open_.argmin(1)[:, None]
            if not np.isfinite(open_[rows, best]).any():
                break
            done[rows, best] = True
            more = self.edges[ids[rows, best][:, 0]]
            old = seen[rows, more] | ~np.isfinite(open_[rows, best])
            seen[rows, more] = True
            d = np.where(old, np.inf, far(more))
            ids, dist, done = np.concatenate((ids, more), 1), np.concatenate((dist, d), 1), np.concatenate((done, old), 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, 1)[:, :beam]
                ids, dist, done = ids[rows, keep], dist[rows, keep], done[rows, keep]
        order = np.argsort(dist, 1, kind="stable")[:, :most]
        return ids[rows, order], dist[rows, order]

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of each row's lists: the nearest centroid's, and further ones' that are not nearer to a chosen one than to the row."""
        ids, dist = self.search(x, 2 * REPLICAS)
        dist = np.sqrt(np.maximum(dist, 0))
        chosen = np.zeros(ids.shape, bool)
        chosen[:, 0] = True
        for j in range(1, ids.shape[1]):
            ok = (dist[:, j] <= (1 + BOUNDARY) * dist[:, 0]) & (chosen.sum(1) < REPLICAS)
            for i in range(j):
                apart = np.sqrt(((self.centroids[ids[:, i]] - self.centroids[ids[:, j]]) ** 2).sum(1))
                ok &= ~chosen[:, i] | (apart >= 0.7 * dist[:, j])
            chosen[:, j] = ok
        row, col = np.nonzero(chosen)
        return row, ids[row, col]

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that each query looks at."""
        n, most = len(self.centroids), 64
        while True:
            ids, dist = self.search(x, most)
            ratio = np.sqrt(np.maximum(dist, 0)) <= (1 + self.slack) * np.sqrt(np.maximum(dist[:, :1], 0)) + 1e-12
            ratio[:, :LEAST_LISTS] = True
            if most >= n or not ratio[:, -1].any():
                row, col = np.nonzero(ratio)
                return row, ids[row, col]
            most *= 2


def fit_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Lloyd's steps on the sample in which full clusters seem farther away."""
    if lists >= len(x):
        return x.copy()
    c = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    spread = float(x.var(0).sum()) / 10
    load = np.zeros(lists)
    for step in range(12):
        near = np.concatenate([((c**2).sum(1) - 2 * part @ c.T + spread * load).argmin(1) for part in np.array_split(x, len(x) // 2048 + 1)])
        count = np.bincount(near, minlength=lists)
        load = 0.5 * load + 0.5 * (count * lists / len(x) - 1).clip(-1, 3) * min(1, step / 4)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def in_line(c: np.ndarray) -> np.ndarray:
    """An order of centroids in which near ones mostly have near places: halves by the widest coordinate, and so on."""
    def halves(ids: np.ndarray) -> list[np.ndarray]:
        if len(ids) <= 2:
            return [ids]
        by = ids[np.argsort(c[ids, c[ids].var(0).argmax()], kind="stable")]
        return [*halves(by[: len(by) // 2]), *halves(by[len(by) // 2 :])]

    return np.concatenate(halves(np.arange(len(c))))


def calibrate(graph: CentroidGraph, x: np.ndarray, k: int, queries: int = 300) -> float:
    """The slack with which queries from the sample find RECALL of their k nearest."""
    q = x[:queries]
    row, home = graph.homes(x)
    lists: list[list[int]] = [[] for _ in x]
    for r, h in zip(row.tolist(), home.tolist(), strict=True):
        lists[r].append(h)
    flat = q.copy()
    flat[:, -1] = 0
    score = flat @ x.T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    c = graph.centroids
    aim = as_query(q[:, :-1], float(np.sqrt((x**2).sum(1).max())))
    dist = np.sqrt(np.maximum((c**2).sum(1) - 2 * aim @ c.T + (aim**2).sum(1)[:, None], 0))
    need = []
    for i in range(len(q)):
        for t in np.argsort(-score[i], kind="stable")[: min(k, len(x) - 1)]:
            need.append(dist[i, lists[t]].min() / max(dist[i].min(), 1e-12) - 1)
    return float(np.quantile(need, RECALL)) if need else 0.0


def as_query(v: np.ndarray, length: float) -> np.ndarray:
    norm = np.sqrt((v**2).sum(1))[:, None]
    return np.concatenate((v * (length / np.maximum(norm, 1e-300)), np.zeros((len(v), 1))), 1)


def as_point(v: np.ndarray, length: float) -> np.ndarray:
    return np.concatenate((v, np.sqrt(np.maximum(length**2 - (v**2).sum(1), 0))[:, None]), 1)


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of x for each q: larger score first, ties to the smaller id; scores summed in the order of the coordinates.

    A matrix product tells which may be among them: all that its rounding error leaves possible are scored exactly, so ties at the end are settled by id however many there are.
    """
    rough = q @ x.T
    take = min(len(x), k)
    last = np.partition(rough, len(x) - take, 1)[:, len(x) - take]
    error = 4 * q.shape[1] * np.finfo(float).eps * np.sqrt((q**2).sum(1) * (x**2).sum(1).max(initial=0.0))
    take = max(take, int((rough >= (last - error)[:, None]).sum(1).max(initial=0)))
    at = np.argpartition(-rough, take - 1, 1)[:, :take]
    score = np.zeros(at.shape)
    for d in range(q.shape[1]):
        score += q[:, d, None] * x[at, d]
    order = np.lexsort((ids[at], -score))[:, :k]
    rows = np.arange(len(q))[:, None]
    return ids[at][rows, order], score[rows, order]


def _blocks(postings: DataFrame, probes: DataFrame) -> list[tuple[int, int, int, int]]:
    """(list, block, parts, turns) of each list that is looked at: blocks of neighbouring lists with about BLOCK vectors; a longer list is cut into parts.

    The postings of a block meet its probes in turns. There are at most MOST_LISTS lists.
    """
    size = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    asked = {r["list"]: r["count"] for r in probes.groupBy("list").count().collect()}
    block, held, load = 0, 0, {}
    of = {}
    for one in sorted(size.keys() & asked.keys()):
        if held and held + size[one] > BLOCK:
            block, held = block + 1, 0
        of[one] = block
        held += size[one]
        n, w = load.get(block, (0, 0))
        load[block] = (n + size[one], w + asked[one])
    return [(one, b, -(-load[b][0] // (2 * BLOCK)), -(-load[b][1] // (2 * BLOCK))) for one, b in of.items()]


def nearest(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score: for each row for which the condition is_query(key column) holds, k rows other than itself.

    Score is the inner product in double precision; larger first, ties to the smaller key. Vectors that are
    null, empty or zero, that hold nulls or non-finite components, or that have another dimension than most
    (of two equally frequent ones the larger) take no part, nor do rows without a key. Of rows that repeat a
    key, the one with the least vector counts. Fewer candidates than k are all returned; an empty table gives
    no rows. vectors is read five times.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    as_stored = np.dtype(np.float32 if single else np.float64)
    valid = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    sized = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sized is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{key}` {kind}, score double")
    dims = sized["d"]
    valid = valid.filter(F.size("v") == dims)
    if valid.groupBy("id").count().filter("count > 1").head(1):
        valid = written(valid.groupBy("id").agg(F.min("v").alias("v")), "valid")
    # A vector's k + 1 smallest keys are all that any query can return of its copies; the rest goes before the shuffle.
    few = valid.withColumn("i", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("i") <= k + 1)
    reps = written(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.get("ids", 0).alias("rep"), "v", "ids"), "reps")
    n, longest = reps.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    length = float(np.sqrt(longest))
    most = max(k + 1, SAMPLE_COORDINATES // dims)
    sample = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(most).toArrow()
    x = as_point(np.array(sample["v"].to_pylist(), float).reshape(-1, dims), length)
    centroids = fit_centroids(x, min(MOST_LISTS, -(-n // LIST_SIZE)))
    graph = CentroidGraph.of(centroids[in_line(centroids)])
    graph.slack = calibrate(graph, x, k)

    def listed(point, lists):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, len(b), 1024):
                    part = b.slice(s, 1024)
                    v = np.asarray(part.column(1).flatten()).reshape(-1, dims)
                    row, home = lists(point(v, length))
                    body = pa.array([x.tobytes() for x in v.astype(as_stored)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), part.column(0).take(pa.array(row)), body.take(pa.array(row))], ["list", "rep", "v"])

        return run

    schema = f"list int, rep {kind}, v binary"
    postings = written(reps.select("rep", "v").mapInArrow(listed(as_point, graph.homes), schema), "postings")
    weight = valid.groupBy("v").agg(F.min("id").alias("rep"), F.sum(is_query(F.col("id")).cast("int")).alias("w")).filter("w > 0")
    asked = written(weight, "asked")
    queries = written(lookup_join(written(valid.filter(is_query(F.col("id"))), "queries"), asked, "v", "w", "inner").select("id", "rep"), "query-reps")
    probes = written(asked.select("rep", "v").mapInArrow(listed(as_query, graph.probes), schema), "probes")

    blocks = _blocks(postings, probes)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        mine, theirs = ("part", "turn") if own == "parts" else ("turn", "part")
        spread = df.join(F.broadcast(spark.createDataFrame(blocks, "list int, block int, parts int, turns int")), "list").withColumn(mine, F.pmod(F.xxhash64("rep"), F.col(own)).cast("int"))
        return spread.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).select("block", "part", "turn", "list", "rep", "v").groupBy("block", "part", "turn")

    def match(points: pa.Table, asks: pa.Table) -> pa.Table:
        kinds = (points if len(points) else asks).schema.field("rep").type
        if not len(points) or not len(asks):
            return pa.table({"ask": pa.array([], kinds), "rep": pa.array([], kinds), "neg": pa.array([], pa.float64())})
        points, asks = points.sort_by("list"), asks.sort_by("list")
        rep, x, q = np.asarray(points["rep"]), _matrix(points["v"], dims, as_stored), _matrix(asks["v"], dims, as_stored)
        own, wanted = np.asarray(points["list"]), np.asarray(asks["list"])
        name = asks["rep"].combine_chunks().dictionary_encode()
        of = np.asarray(name.indices).astype(np.int64)
        rows, reps_, negs = [np.zeros(0, np.int64)], [rep[:0]], [np.zeros(0)]
        for one in np.unique(wanted):
            a, b = np.searchsorted(own, [one, one + 1])
            c, d = np.searchsorted(wanted, [one, one + 1])
            step = max(1, SCORES // max(1, b - a))
            for s in range(c, d if b > a else c, step):
                e = min(d, s + step)
                ids, scores = _best(q[s:e], x[a:b], rep[a:b], k + 1)
                rows.append(np.repeat(of[s:e], ids.shape[1]))
                reps_.append(ids.ravel())
                negs.append(-scores.ravel())
        row, ids, neg = np.concatenate(rows), np.concatenate(reps_), np.concatenate(negs)
        order = np.lexsort((ids, neg, row))
        row, ids, neg = row[order], ids[order], neg[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
        row, ids, neg = row[new], ids[new], neg[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        few = place <= k
        return pa.table({"ask": name.dictionary.take(pa.array(row[few])), "rep": pa.array(ids[few], kinds), "neg": pa.array(neg[few])})

    found = dealt(postings, "parts", "turns").cogroup(dealt(probes, "turns", "parts")).applyInArrow(match, f"ask {kind}, rep {kind}, neg double")
    # A vector found in several blocks has one score, so the dense rank counts it once; all but k + 1 of each task go before the shuffle.
    ranked = found.withColumn("r", F.dense_rank().over(W.partitionBy("ask").orderBy("neg", "rep"))).filter(F.col("r") <= k + 1)
    best = written(ranked.groupBy("ask", "rep").agg(F.min("neg").alias("neg")), "best")
    # Most vectors have no copies; those that have may be found by very many queries.
    twins = reps.filter(F.size("ids") > 1).select("rep", "ids")
    met = best.groupBy("rep").agg(F.count("*").alias("w"))
    spread = lookup_join(best, written(twins.join(met, "rep"), "twins"), "rep", "w").withColumn("ids", F.coalesce("ids", F.array("rep")))
    expanded = spread.select("ask", F.transform("ids", lambda i: F.struct(F.col("neg").alias("neg"), i.alias("id"))).alias("m"))
    answers = expanded.groupBy("ask").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, k + 1).alias("m"))
    counts = queries.groupBy("rep").agg(F.count("*").alias("w"))
    answers = written(answers.withColumnRenamed("ask", "rep").join(counts, "rep"), "answers")
    each = lookup_join(queries, answers, "rep", "w", "inner")
    own = F.slice(F.filter("m", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.id").alias(key), (-F.col("x.neg")).alias("score"))
