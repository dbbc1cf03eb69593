"""Exact deduplication by a log-structured merge index of digests.

Each task fills a memtable of digests; a full one is flushed as a sorted run in which a digest has one
entry: the identifier that stays and how many rows it stands for. A run comes with its key range and a
filter of its digests, so that a lookup reads only the runs that may hold what is looked up. Compaction
merges all runs in order into one level, streaming through range partitions, and keeps the smallest (or
largest) identifier of a digest. What the level says was met more than once is verified byte by byte;
texts that only share a digest are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bloom import Bloom, bloom, without
from quire.llm.common import again, lookup_join, numbered, written

MEMTABLE_ROWS = 200_000
#: Entries of a level in one of its blocks, about; each block has a range and a filter like a run.
BLOCK_ROWS = 200_000


def _folded(tables: list[pa.Table], keep: str) -> pa.Table:
    """(digest, keep_id, n) with one entry per digest, in the order in which digests are met."""
    t = pa.concat_tables(tables).group_by("digest", use_threads=False).aggregate([("keep_id", keep), ("n", "sum")])
    return t.rename_columns({f"keep_id_{keep}": "keep_id", "n_sum": "n"}).select(["digest", "keep_id", "n"])


def _hash(digests: list[bytes]) -> np.ndarray:
    """Eight bytes of each digest, mixed, as short test digests have few bits."""
    h = np.array([int.from_bytes(d[:8].ljust(8, b"\0"), "little") for d in digests], np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _block(t: pa.Table, run: int) -> Iterator[pa.RecordBatch]:
    """A sorted table as rows of a run, after a row of its own with the range and the filter."""
    d = t["digest"].to_pylist()
    n, one = len(d), pa.array([run], pa.int64())
    kinds = [t.schema.field("keep_id").type, pa.binary(), pa.binary()]
    head = [one, pa.array([d[0]], pa.binary()), pa.nulls(1, kinds[0]), pa.array([n], pa.int64()), pa.array([d[-1]], pa.binary()), pa.array([Bloom.of(_hash(d)).words.tobytes()], pa.binary())]
    names = ["run", "digest", "keep_id", "n", "last", "filter"]
    yield pa.RecordBatch.from_arrays(head, names)
    body = [pa.array(np.full(n, run)), t["digest"].combine_chunks(), t["keep_id"].combine_chunks(), t["n"].combine_chunks(), pa.nulls(n, kinds[1]), pa.nulls(n, kinds[2])]
    yield pa.RecordBatch.from_arrays(body, names)


class LsmIndex:
    """digest -> (keep_id, n). Runs and levels are Parquet tables in the shared folder.

    Their rows are (run, digest, keep_id, n, last, filter). A run's first row has a filter, its least and largest
    digest (digest, last) and its number of entries (n); all others are entries.
    """

    def __init__(self, spark: SparkSession, keep: str = "min", memtable_rows: int = MEMTABLE_ROWS):
        if keep not in ("min", "max"):
            raise ValueError("keep is min or max")
        self.spark, self.keep, self.memtable_rows, self.levels, self.merged = spark, keep, memtable_rows, [], True

    def _schema(self, kind: str) -> str:
        return f"run long, digest binary, keep_id {kind}, n long, last binary, filter binary"

    def insert(self, rows: DataFrame) -> None:
        """Add rows (digest binary, id): memtables, flushed as sorted runs, become a level of their own. Null digests take no part."""
        keep, most = self.keep, self.memtable_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, flushed = TaskContext.get().partitionId(), 0
            held: list[pa.Table] = []
            size = 0
            for b in batches:
                # A batch longer than a memtable fills several.
                for s in range(0, len(b), most):
                    own = b.slice(s, most)
                    held.append(pa.table({"digest": own.column(0), "keep_id": own.column(1), "n": pa.array(np.ones(len(own), np.int64))}))
                    size += len(own)
                    if size >= most:
                        yield from _block(_folded(held, keep).sort_by("digest"), (part << 20) + flushed)
                        held, size, flushed = [], 0, flushed + 1
            if held:
                yield from _block(_folded(held, keep).sort_by("digest"), (part << 20) + flushed)

        kind = rows.schema["id"].dataType.simpleString()
        self.levels.append(written(rows.select("digest", "id").filter("digest is not null").mapInArrow(run, self._schema(kind)), "lsm-runs"))
        self.merged = False

    def entries(self, level: DataFrame) -> DataFrame:
        return level.filter("filter is null").select("digest", "keep_id", "n")

    def compact(self) -> DataFrame:
        """Merge all levels into one, with an entry per digest; returns its entries.

        Entries are dealt to ranges of digests and sorted there; a range is merged in one pass, which holds a batch
        and the entry that may go on in the next one. A digest has one entry in each run, so none makes a range large.
        """
        if self.merged:
            return self.entries(self.levels[0])
        keep = self.keep
        runs = self.entries(self.levels[0])
        for more in self.levels[1:]:
            runs = runs.unionByName(self.entries(more))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, blocks = TaskContext.get().partitionId(), 0
            done: list[pa.Table] = []
            size = 0
            last: pa.Table | None = None
            for b in batches:
                if not len(b):
                    continue
                met = _folded([*([last] if last is not None else []), pa.Table.from_batches([b])], keep)
                done.append(met.slice(0, len(met) - 1))
                size += len(met) - 1
                last = met.slice(len(met) - 1)
                if size >= BLOCK_ROWS:
                    yield from _block(pa.concat_tables(done), (part << 20) + blocks)
                    done, size, blocks = [], 0, blocks + 1
            if last is not None:
                yield from _block(pa.concat_tables([*done, last]), (part << 20) + blocks)

        kind = runs.schema["keep_id"].dataType.simpleString()
        ordered = runs.repartitionByRange("digest").sortWithinPartitions("digest")
        self.levels = [written(ordered.mapInArrow(merge, self._schema(kind)), "lsm-level")]
        self.merged = True
        return self.entries(self.levels[0])

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digest, keep_id, n of each distinct one of digests (column digest) that the index holds; merges first what is not merged yet.

        A digest is sent to the one run of the level whose range it lies in; the runs' filters, one task a run, drop
        nearly all that a run lacks; only then are entries joined.
        """
        self.compact()
        level = self.levels[0]
        asked = digests.select("digest").filter("digest is not null").distinct()
        heads = again(level).filter("filter is not null").select("run", F.col("digest").alias("least"), "last")
        prefix = lambda c: F.conv(F.rpad(F.hex(F.substring(c, 1, 2)), 4, "0"), 16, 10).cast("int")
        # Ranges do not overlap, so all runs together have at most one row for each prefix, and one more for each run.
        spread = heads.select("run", "least", "last", F.explode(F.sequence(prefix("least"), prefix("last"))).alias("p"))
        sent = asked.withColumn("p", prefix("digest")).join(spread, "p").filter("digest between least and last").select("run", "digest")

        def passed(wanted: pa.Table, head: pa.Table) -> pa.Table:
            if not len(wanted) or not len(head):
                return pa.table({"run": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())})
            some = Bloom(np.frombuffer(head["filter"][0].as_py(), np.uint64))
            return wanted.select(["run", "digest"]).filter(pa.array(some.maybe(_hash(wanted["digest"].to_pylist()))))

        filters = again(level).filter("filter is not null").select("run", "filter")
        maybe = sent.groupBy("run").cogroup(filters.groupBy("run")).applyInArrow(passed, "run long, digest binary")
        return level.filter("filter is null").join(maybe, ["run", "digest"]).select("digest", "keep_id", "n")


def exact_groups(df: DataFrame, keep: str = "min", text: str = "text", key: str = "doc_id", digest_bytes: int = 32) -> DataFrame:
    """One row per row of df: key, keep_id (of the row that stays of all with the same text), group_size, kept, sha256 (binary, of the text).

    Null texts count as empty; texts are equal when identical. Rows that repeat a key with the same text
    are kept or dropped together. A null key stays only where all keys of its group are null. An empty
    table gives no rows. df is read twice.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    source = df.select(F.col(key).alias("__id"), body.alias("__text"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("__sha"))
    digest = F.substring("__sha", 1, digest_bytes)
    rows = written(source.select("__id", "__sha"), "digests")
    index = LsmIndex(df.sparkSession, keep)
    index.insert(rows.select(digest.alias("digest"), F.col("__id").alias("id")))
    met = index.compact().filter("n > 1")
    count = met.count()
    best = F.min if keep == "min" else F.max
    if not count:
        found = rows.select("__id", "__sha", F.lit(None).cast(rows.schema["__id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("n"))
    else:
        # Byte verification: texts whose digest the level met more than once are grouped whole, after a map-side combine.
        again = source.select("__id", "__text", digest.alias("digest")).filter(bloom(met.select(F.xxhash64("digest").alias("h")), "h", count).holds(F.xxhash64("digest")))
        same = again.groupBy("digest", "__text").agg(best("__id").alias("own_id"), F.count("*").alias("own_n"))
        texts = written(same.select("digest", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("__sha"), "own_id", "own_n"), "verified")
        # The level's entry holds where all rows of its digest have one text; other digests are told apart by their texts.
        sound = met.join(texts.select("digest", "__sha", F.col("own_n").alias("n")), ["digest", "n"])
        apart = texts.join(sound.select("digest"), "digest", "left_anti").filter("own_n > 1")
        groups = sound.select("__sha", "keep_id", "n").unionByName(apart.select("__sha", F.col("own_id").alias("keep_id"), F.col("own_n").alias("n")))
        found = lookup_join(rows, written(groups.withColumn("__weight", F.col("n")), "groups"), "__sha", "__weight")
    return found.select(
        F.col("__id").alias(key), F.when(F.col("n").isNull(), F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("__sha").alias("sha256"),
    )


def exact_dedup(df: DataFrame, keep: str = "min", text: str = "text", key: str = "doc_id") -> DataFrame:
    """df's rows that stay, with all columns: of each text one row, that of the key to keep; a null key only where its group has no other.

    Null texts count as empty, ties and repeated rows leave one row, an empty table gives no rows.
    """
    rows = numbered(df, key, text, nulls_first=keep == "max")
    if rows is not None:
        return exact_dedup(rows, keep, text, "__row").drop("__row")
    dropped = written(exact_groups(df, keep, text, key).filter("not kept").select(key), "dropped")
    return without(df, dropped, key)
