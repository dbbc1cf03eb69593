"""Page lookups: J6, J9, J14, A11, A12, W7, G1, S20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.geom import clamp
from quire.operators.islands import monotone

# Units of the book: id, title, first and last page.
UNITS = [
    ("I-1", "Ⅰ-1. 평면좌표", 10, 32),
    ("I-2", "Ⅰ-2. 직선의 방정식", 33, 64),
    ("I-3", "Ⅰ-3. 원의 방정식", 65, 96),
    ("I-4", "Ⅰ-4. 도형의 이동", 97, 118),
    ("II-1", "Ⅱ-1. 집합의 뜻과 포함 관계", 119, 136),
    ("II-2", "Ⅱ-2. 집합의 연산", 137, 164),
    ("II-3", "Ⅱ-3. 명제", 165, 204),
    ("III-1", "Ⅲ-1. 함수", 205, 246),
    ("III-2", "Ⅲ-2. 유리함수", 247, 274),
    ("III-3", "Ⅲ-3. 무리함수", 275, 291),
]
FIRST_PAGE, LAST_PAGE = 10, 291


def units(spark: SparkSession) -> DataFrame:
    """unit, title, start_page, end_page: ten rows."""
    return spark.createDataFrame(UNITS, "unit string, title string, start_page int, end_page int")


def unit_of(pages: DataFrame, unit_table: DataFrame, page: str = "page", default_first: bool = False) -> DataFrame:
    """Pages with the unit that holds them, null (or the first unit) outside all. Units do not overlap; each is taken page by page, so the join is by equal pages."""
    each = unit_table.select("unit", "start_page", "end_page", F.explode(F.sequence("start_page", "end_page")).alias("__p"))
    met = pages.join(each, F.col(page) == F.col("__p"), "left").drop("__p")
    return met.withColumn("unit", F.coalesce("unit", F.lit(UNITS[0][0]))) if default_first else met


def start_page(saved: DataFrame, unit_table: DataFrame) -> DataFrame:
    """Where to open: the saved page in its unit, the first unit's start if there is none or it is outside all."""
    met = unit_of(saved, unit_table)
    return met.select(*saved.columns, F.coalesce("unit", F.lit(UNITS[0][0])).alias("unit"), F.when(F.col("unit").isNotNull(), F.col("page")).otherwise(F.lit(UNITS[0][2])).alias("open_page"))


def unit_progress(unit_table: DataFrame, status: DataFrame) -> DataFrame:
    """Done and pending pages of each unit; a page without a status is pending."""
    pages = unit_table.select("unit", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    done = F.coalesce(F.col("status") == "done", F.lit(False)).cast("long")
    return pages.join(status, "page", "left").groupBy("unit").agg(F.sum(done).alias("done"), (F.count("*") - F.sum(done)).alias("pending"))


def first_answers(anchors: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each covered page (k) the smallest answer page (v) of the anchors that cover it. keys: those of the book."""
    return anchors.select(*keys, "answer_page", F.explode(F.sequence("a", "b")).alias("k")).groupBy(*keys, "k").agg(F.min("answer_page").alias("v"))


def interpolated(known: DataFrame, count: int, first: int = FIRST_PAGE, last: int = LAST_PAGE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Keys, page, answer_page for first..last of each book: known (k, v), else between the nearest known pages below and above, half-even, else the nearest one.

    Known pages outside first..last count as neighbours: of those below the last one, of those above the first one, so a
    book has at most last - first + 3 rows here. Without keys there is one book, without any known page no answer (null).
    """
    known = known.select(*keys, F.col("k").cast("long").alias("k"), F.col("v").cast("double").alias("v"))
    inside = known.filter(F.col("k").between(first, last))
    below = known.filter(F.col("k") < first).groupBy(*keys).agg(F.max_by("v", "k").alias("v"), F.max("k").alias("k")).filter("k is not null").select(*keys, "k", "v")
    above = known.filter(F.col("k") > last).groupBy(*keys).agg(F.min_by("v", "k").alias("v"), F.min("k").alias("k")).filter("k is not null").select(*keys, "k", "v")
    pages = F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("k")
    domain = known.select(*keys).distinct().select(*keys, pages) if keys else known.sparkSession.range(1).select(pages)
    all_ = domain.join(inside, [*keys, "k"], "left").select(*keys, "k", "v").unionByName(below).unionByName(above)
    w = W.partitionBy(*keys).orderBy("k")
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col("v").isNotNull(), F.col("k"))
    near = all_.select(*keys, "k", "v", F.last(at, True).over(before).alias("k0"), F.last("v", True).over(before).alias("v0"), F.first(at, True).over(after).alias("k1"), F.first("v", True).over(after).alias("v1"))
    between = F.col("v0") + (F.col("k") - F.col("k0")) / (F.col("k1") - F.col("k0")) * (F.col("v1") - F.col("v0"))
    value = F.when(F.col("v").isNotNull(), F.col("v")).when(F.col("k0").isNotNull() & F.col("k1").isNotNull(), F.bround(between)).otherwise(F.coalesce("v0", "v1"))
    return near.filter(F.col("k").between(first, last)).select(*keys, F.col("k").alias("page"), F.when(value.isNotNull(), clamp(value.cast("long"), 1, count)).alias("answer_page"))


def page_map(raw: DataFrame, count: int, keys: tuple[str, ...]) -> DataFrame:
    """S20 without its pictures: W6, A11, W7 in each book. raw: keys, answer_page, a, b."""
    return interpolated(first_answers(monotone(raw, list(keys), "answer_page", "a"), keys), count, keys=keys)


def answers_document(mapped: DataFrame, keys: tuple[str, ...], count: int, width: int, height: int) -> DataFrame:
    """Keys, document: a book's answers.json: schema version, number and size of its answer pages, and the page map. Pages without an answer are left out."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("answer_page").isNotNull(), F.struct("page", "answer_page"))))
    pages = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["page"].cast("string"), e["answer_page"])))
    parts = F.struct(F.lit("1.0").alias("schema_version"), F.lit(count).alias("count"), F.lit(width).alias("page_w"), F.lit(height).alias("page_h"), F.col("page_map"))
    return mapped.groupBy(*keys).agg(pages.alias("page_map")).select(*keys, F.to_json(parts).alias("document"))


def answer_for(asked: DataFrame, mapped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mapped answer page, or that of the page clamped between the first and the last mapped one of its book."""
    ends = mapped.groupBy(*keys).agg(F.min("page").alias("__lo"), F.max("page").alias("__hi"))
    met = asked.join(ends, list(keys), "left") if keys else asked.crossJoin(ends)
    exact = met.join(mapped.select(*keys, "page", F.col("answer_page").alias("__v")), [*keys, "page"], "left")
    key: Column = F.greatest("__lo", F.least("__hi", "page"))
    found = exact.withColumn("__k", key).join(mapped.select(*keys, F.col("page").alias("__k"), F.col("answer_page").alias("__w")), [*keys, "__k"], "left")
    return found.select(*asked.columns, F.coalesce("__v", "__w").alias("answer_page"))
