"""Classification with a cache by content hash: J7, S7, F1, P7, STR1, R13."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import content_hash, override_type, parse_reply, role_of


def with_hash(crops: DataFrame, data: str = "image") -> DataFrame:
    """R13, H1."""
    return crops.withColumn("image_hash", content_hash(F.col(data)))


def cache_lookup(crops: DataFrame, cache: DataFrame) -> DataFrame:
    """Crops with their cached type, confidence and flag; hit tells whether there is one."""
    return crops.join(cache.withColumn("hit", F.lit(True)), "image_hash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(crops: DataFrame, cache: DataFrame, force: bool = False) -> DataFrame:
    """Each content to be classified once: all of them if forced, else those that the cache lacks."""
    each = crops.dropDuplicates(["image_hash"])
    return each if force else each.join(cache.select("image_hash"), "image_hash", "left_anti")


def classify(crops: DataFrame, backend: Callable[[], Callable[[bytes], str]], data: str = "image") -> DataFrame:
    """image_hash, raw reply, type, confidence, needs_review. backend() is called once in each task and gives the function bytes -> reply."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = backend()
        for f in frames:
            yield pd.DataFrame({"image_hash": f["image_hash"], "raw": [ask(bytes(x)) for x in f[data]]})

    replies = crops.select("image_hash", data).mapInPandas(run, "image_hash string, raw string")
    return replies.withColumn("p", parse_reply(F.col("raw"))).select("image_hash", "raw", "p.*")


def refreshed(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new results, which replace those of before."""
    columns = ["image_hash", "type", "confidence", "needs_review"]
    return cache.select(columns).join(new.select("image_hash"), "image_hash", "left_anti").unionByName(new.select(columns))


def final_types(blocks: DataFrame, wide: float = 0.08) -> DataFrame:
    """Type after the rules, and its role. blocks: type, w, number_coloured."""
    return blocks.withColumn("type", override_type(F.col("type"), F.col("w"), F.col("number_coloured"), wide)).withColumn("role", role_of(F.col("type")))
