"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.tables import close, delete, staged

__all__ = ["again", "close", "discard", "drop", "give_back", "lookup_join", "numbered", "ready", "written"]


#: What Python workers are started with: freed memory goes back to the machine, as idle workers stay and share an executor's memory with busy ones.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20)}


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; elsewhere ship it with --py-files."""
    for name, value in {"PYTHONPATH": str(Path(__file__).resolve().parents[2]), **WORKERS}.items():
        spark.sparkContext.environment.setdefault(name, value)


#: Cut the lineage: a table in the shared folder, which outlives any executor.
written = staged


def again(table: DataFrame) -> DataFrame:
    """A table that written() made, as a frame of its own, for use beside itself."""
    return table.sparkSession.read.schema(table.schema).parquet(table._quire_path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for table in tables:
        delete(table.sparkSession, table._quire_path)


def discard(*tables: DataFrame) -> None:
    """As drop(), let Spark remove the shuffle files of finished jobs, and give_back()."""
    drop(*tables)
    spark = tables[0].sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back(spark)


def give_back(spark: SparkSession) -> None:
    """Let executors return the heap that is not in use to the machine, between two large steps.

    A heap that grew in one step keeps its size, up to all it may have, while Python workers beside it need memory in the
    next one. Only a full collection is sure to shrink it; one task for each core asks for that, so each executor gets some.
    """
    if spark.sparkContext.master.startswith("local["):  # the driver, which discard() has collected
        return
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def numbered(df: DataFrame, key: str, text: str, nulls_first: bool = False) -> DataFrame | None:
    """df, written out with a number of its own for each row (__row, long, in the order of the keys); None if keys are unique and not null."""
    if not df.groupBy(key).agg(F.count("*").alias("__n")).filter((F.col("__n") > 1) | F.col(key).isNull()).head(1):
        return None
    by = F.col(key).asc_nulls_first() if nulls_first else F.col(key).asc_nulls_last()
    return written(df.orderBy(by, F.xxhash64(text)).withColumn("__row", F.monotonically_increasing_id()), "numbered")


#: At most this many keys count as heavy in lookup_join, so what it broadcasts is bounded.
HEAVY_KEYS = 2000


def lookup_join(big: DataFrame, table: DataFrame, key: str, weight: str, how: str = "left", weighted: bool = False) -> DataFrame:
    """big joined with table, whose key is unique and whose weight column counts the rows of big with that key.

    A key that holds a large share of big's rows would land in one task. Those keys are at most
    HEAVY_KEYS (each holds over 1/HEAVY_KEYS of all weight), so their rows are broadcast; all other
    keys are joined by a shuffle. Both tables should be cheap to read twice.
    weighted: the weight column stays in the result.
    """
    if weighted:
        table = table.withColumn("__weight", F.col(weight))
        weight = "__weight"
    total = table.agg(F.sum(weight)).first()[0] or 0
    least = max(1000, total // HEAVY_KEYS + 1)
    columns = [c for c in table.columns if c not in (key, weight)]
    heavy = table.filter(F.col(weight) >= least).drop(weight)
    if not heavy.head(1):
        return big.join(table.drop(weight).hint("shuffle_merge"), key, how)
    hot = big.join(F.broadcast(heavy), key, "inner")
    rest = big.join(F.broadcast(heavy.select(key)), key, "left_anti")
    light = table.filter(F.col(weight) < least).drop(weight)
    return rest.join(light.hint("shuffle_merge"), key, how).unionByName(hot).select(*big.columns, *columns)
