from collections import Counter

import numpy as np
import pytest
from quire.llm import bloom, lsm_dedup
from pyspark.sql import functions as F

ROWS = [(i, t) for i, t in enumerate([None, "", "a", "a", "A", "b" * 90_000, "b" * 90_000, " a", "c", "é", "é", None] + ["hot"] * 500 + [f"t{i % 40}" for i in range(200)])]


def brute(rows, keep):
    best, count = {}, Counter(t or "" for _, t in rows)
    for d, t in rows:
        best[t or ""] = keep(best.get(t or "", d), d)
    return sorted((d, best[t or ""], count[t or ""], best[t or ""] == d) for d, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, keep_id int, digest string").repartition(4)


@pytest.mark.parametrize("keep,best", [("min", min), ("max", max)])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_like_brute_force(spark, keep, best, digest_bytes):
    got = lsm_dedup.exact_groups(frame(spark, ROWS), keep, digest_bytes=digest_bytes).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == brute(ROWS, best)


def digests(df):
    return df.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), F.col("doc_id").alias("id"))


def test_runs_are_sorted_and_merged(spark):
    index = lsm_dedup.LsmIndex(spark, "min", memtable_rows=50)
    df = digests(frame(spark, ROWS))
    index.insert(df.filter("id < 300"))
    index.insert(df.filter("id >= 300"))
    for level in index.levels:
        for _, r in level.toPandas().groupby("run"):
            head, r = r[r["filter"].notna()].iloc[0], r[r["filter"].isna()]
            assert 0 < len(r) <= 50 and head.n == len(r) and r.n.sum() <= 50
            assert r.digest.is_monotonic_increasing and r.digest.is_unique
            assert (head.digest, head["last"]) == (r.digest.iloc[0], r.digest.iloc[-1])
            own = lsm_dedup._hash([bytes(d) for d in r.digest])
            some = lsm_dedup.Bloom(np.frombuffer(head["filter"], np.uint64))
            assert some.maybe(own).all() and some.maybe(~own).mean() < 0.2
    level = index.compact().collect()
    assert len({bytes(r.digest) for r in level}) == len(level) and sum(r.n for r in level) == len(ROWS)
    assert len(index.levels) == 1


@pytest.mark.parametrize("block", [200_000, 16])
def test_batches_against_a_stored_level(spark, monkeypatch, block):
    monkeypatch.setattr(lsm_dedup, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    index = lsm_dedup.LsmIndex(spark, "min", memtable_rows=64)
    parts = [[r for r in ROWS if r[0] % 3 == i] for i in range(3)]
    known = {}
    for part in parts:
        batch = digests(frame(spark, part))
        if index.levels:
            got = {bytes(r.digest): (r.keep_id, r.n) for r in index.lookup(batch).collect()}
            own = {bytes(r.digest) for r in batch.collect()}
            assert got == {d: v for d, v in known.items() if d in own} and got
            unknown = spark.createDataFrame([(bytes(32),), (b"\xff" * 32,), (None,)], "digest binary")
            assert index.lookup(unknown).count() == 0
        index.insert(batch)
        for r in batch.collect():
            keep, n = known.get(bytes(r.digest), (r.id, 0))
            known[bytes(r.digest)] = (min(keep, r.id), n + 1)
    assert {bytes(r.digest): (r.keep_id, r.n) for r in index.compact().collect()} == known
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("small", [0, 8 << 20])
def test_rows_left_out_by_either_join(spark, monkeypatch, small):
    monkeypatch.setattr(bloom, "SMALL_BYTES", small)
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", None), ("w", 2), ("v", 3)], "text string, doc_id long")
    for gone, left in (([1, 2], "vz"), ([], "vwxyz"), ([7], "vwxyz")):
        got = bloom.without(df, spark.createDataFrame([(i,) for i in gone], "doc_id long"), "doc_id")
        assert got.columns == df.columns and sorted(r.text for r in got.collect()) == sorted(left)


def test_repeated_rows_empty_and_kept(spark):
    rows = [(1, "x"), (1, "x"), (2, "y"), (None, "z")]
    got = lsm_dedup.exact_groups(frame(spark, rows), "max").collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(0, None, 1, True), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True)]
    assert lsm_dedup.exact_groups(frame(spark, []).limit(0)).count() == 0
    kept = lsm_dedup.exact_dedup(frame(spark, ROWS), "max")
    assert kept.columns == ["doc_id", "text", "keep_id", "digest"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in brute(ROWS, max) if k)
