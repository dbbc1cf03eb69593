"""Outlier flags, counts and page filters: A1, A2, A3, A16, A17, P8, W10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def flag_outliers(blocks: DataFrame, area: Column, keys: tuple[str, ...] = ("page", "type"), factor: float = 2.5, least: float = 1e-6) -> DataFrame:
    """A1: needs_review where area > factor * max(exact median of the keys' areas, least); replaces the stored flag."""
    measured = blocks.withColumn("area", area).withColumn("median_area", F.median("area").over(W.partitionBy(*keys)))
    return measured.withColumn("needs_review", F.col("area") > factor * F.greatest(F.col("median_area"), F.lit(least)))


def counts(blocks: DataFrame, *keys: str) -> DataFrame:
    """A2."""
    return blocks.groupBy(*keys).agg(F.count("*").alias("n"))


def page_review(blocks: DataFrame) -> DataFrame:
    """Blocks, flags and their ratio for each page."""
    flags = F.sum(F.col("needs_review").cast("long"))
    return blocks.groupBy("page").agg(F.count("*").alias("n_blocks"), flags.alias("n_review"), (flags / F.count("*")).alias("ratio"))


def next_page(flagged: DataFrame, units: DataFrame, current: DataFrame) -> DataFrame:
    """Per (unit, current page) the next page of the unit with a flag, going round and ending at the current page; null without one.

    Units are taken page by page, so pages meet them by equal numbers, and a unit's flagged pages are a list no longer than the unit.
    """
    each = units.select("unit", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    lists = flagged.filter("needs_review").select("page").distinct().join(each, "page").groupBy("unit").agg(F.array_sort(F.collect_list("page")).alias("__f"))
    met = current.join(each.withColumnRenamed("page", "current"), "current").join(lists, "unit", "left")
    after = F.filter("__f", lambda p: p > F.col("current"))
    return met.select("unit", "current", F.coalesce(F.get(after, 0), F.get("__f", 0)).alias("next_page")).distinct()


def chosen_pages(pages: DataFrame, status: DataFrame, which: str = "done") -> DataFrame:
    """Pages (page) that are done, that are not ("pending": without a status too), or in an explicit range "a-b", whatever their status."""
    if which not in ("done", "pending"):
        ends = which.split("-")
        return pages.filter(F.col("page").between(int(ends[0]), int(ends[1])))
    done = status.filter("status = 'done'").select("page").distinct()
    return pages.join(done, "page", "left_semi" if which == "done" else "left_anti")


def remaining(blocks: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("book",)) -> DataFrame:
    """Keys, total, finished, seconds_left: blocks in all and classified so far, and the mean time of those times what is left (null before the first). done: keys, seconds."""
    total = blocks.groupBy(*keys).agg(F.count("*").alias("total"))
    so_far = done.groupBy(*keys).agg(F.count("*").alias("finished"), F.avg("seconds").alias("__mean"))
    met = total.join(so_far, list(keys), "left").withColumn("finished", F.coalesce("finished", F.lit(0)))
    return met.withColumn("seconds_left", F.col("__mean") * (F.col("total") - F.col("finished"))).drop("__mean")
