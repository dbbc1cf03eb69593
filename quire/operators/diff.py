"""Automatic against edited layouts: J1-J5, P9, P10, A4-A6.

All joins are on the page first, so the candidates are pairs within a page, of which there are tens, not pairs of all boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.geom import box, iou


def _side(df: DataFrame, prefix: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select("page", *(F.col(c).alias(f"{prefix}{c}") for c in ("id", "ord", "x", "y", "w", "h", *extra)))


def pairs(auto: DataFrame, edited: DataFrame, least: float, strict: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a page with their IoU of at least (or over) `least`: a_* and e_* columns and iou."""
    met = _side(auto, "a_", extra).join(_side(edited, "e_", extra), "page").withColumn("iou", iou(box("a_"), box("e_")))
    return met.filter(F.col("iou") > least if strict else F.col("iou") >= least)


def greedy_match(auto: DataFrame, edited: DataFrame, least: float = 0.5) -> DataFrame:
    """Page, a_id, e_id, iou: automatic blocks in order each take the unused edited block of largest IoU, the first of equals, if at least `least`.

    Only candidates of at least `least` can be taken, so the fold over a page's blocks sees those alone.
    """
    one = pairs(auto, edited, least).groupBy("page", "a_ord", "a_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("neg"), F.col("e_ord").alias("o"), F.col("e_id").alias("e")))).alias("c"))
    page = one.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("a_ord", "a_id", "c"))).alias("autos"))
    id_type = auto.schema["id"].dataType.simpleString()
    state = f"struct<used:array<{id_type}>,out:array<struct<a_id:{id_type},e_id:{id_type},iou:double>>>"
    start = F.struct(F.array().alias("used"), F.array().alias("out")).cast(state)

    def step(s: Column, a: Column) -> Column:
        best = F.get(F.filter(a["c"], lambda c: ~F.array_contains(s["used"], c["e"])), 0)
        took = F.struct(F.array_append(s["used"], best["e"]).alias("used"), F.array_append(s["out"], F.struct(a["a_id"].alias("a_id"), best["e"].alias("e_id"), (-best["neg"]).alias("iou"))).alias("out"))
        return F.when(best.isNull(), s).otherwise(took.cast(state))

    return page.select("page", F.explode(F.aggregate("autos", start, step)["out"]).alias("m")).select("page", "m.*")


def unmatched(side: DataFrame, matches: DataFrame, id_column: str) -> DataFrame:
    """Deleted blocks (id_column a_id) or added ones (e_id)."""
    return side.join(matches.select("page", F.col(id_column).alias("id")), ["page", "id"], "left_anti")


def without_overlap(badges: DataFrame, boxes: DataFrame, over: float = 0.2) -> DataFrame:
    """Badges that no box of their page overlaps with an IoU over `over`."""
    hit = pairs(badges, boxes, over, strict=True).select("page", F.col("a_id").alias("id"))
    return badges.join(hit, ["page", "id"], "left_anti")


def best_match(truth: DataFrame, found: DataFrame, position: float = 0.3) -> DataFrame:
    """For each truth block the found block of largest IoU, first of equals; position_ok, and type_ok where the position is."""
    met = _side(truth, "a_", ("type",)).join(_side(found, "e_", ("type",)), "page").withColumn("iou", iou(box("a_"), box("e_")))
    best = met.groupBy("page", "a_id", "a_type").agg(F.max_by(F.struct("e_id", "e_type", "iou"), F.struct("iou", -F.col("e_ord"))).alias("b"))
    ok = F.col("b.iou") >= position
    return best.select("page", "a_id", F.col("b.e_id").alias("e_id"), F.col("b.iou").alias("iou"), ok.alias("position_ok"), (ok & (F.col("a_type") == F.col("b.e_type"))).alias("type_ok"))


def accuracy(best: DataFrame) -> DataFrame:
    """Position and type hits, and their shares (of all; of the position hits, or of 1)."""
    p, t = F.sum(F.col("position_ok").cast("long")), F.sum(F.col("type_ok").cast("long"))
    return best.agg(F.count("*").alias("n"), p.alias("position_hits"), t.alias("type_hits"), (p / F.count("*")).alias("coverage"), (t / F.greatest(p, F.lit(1))).alias("type_accuracy"))


def region(x: Column, edge: float | int = 0.65) -> Column:
    """P9."""
    return F.when(x > edge, "sidebar").otherwise("body")


def resized(matches: DataFrame, auto: DataFrame, edited: DataFrame, over: float = 0.01) -> DataFrame:
    """P10: matches of one type of which any of x, y, w, h moved by over `over`."""
    both = matches.join(_side(auto, "a_", ("type",)), ["page", "a_id"]).join(_side(edited, "e_", ("type",)), ["page", "e_id"])
    moved = F.exists(F.zip_with(F.array(*box("a_")), F.array(*box("e_")), lambda p, q: F.abs(p - q)), lambda d: d > over)
    return both.filter((F.col("a_type") == F.col("e_type")) & moved).select("page", "a_id", "e_id")


def type_changes(matches: DataFrame, auto: DataFrame, edited: DataFrame) -> DataFrame:
    """A5."""
    both = matches.join(_side(auto, "a_", ("type",)), ["page", "a_id"]).join(_side(edited, "e_", ("type",)), ["page", "e_id"])
    return both.filter("a_type != e_type").groupBy("a_type", "e_type").agg(F.count("*").alias("n"))


def report(blocks: DataFrame, edge: float | int = 0.65, pages: int = 6) -> DataFrame:
    """Per (type, region) the count and the first pages in order of page and block; place by count, ties by first appearance.

    The pages of a group are taken by rank, so no group's list of all its pages is ever built.
    """
    from pyspark.sql import Window as W

    shown = blocks.withColumn("region", region(F.col("x"), edge))
    groups = shown.groupBy("type", "region").agg(F.count("*").alias("n"), F.min(F.struct("page", "ord")).alias("first"))
    early = shown.withColumn("i", F.row_number().over(W.partitionBy("type", "region").orderBy("page", "ord"))).filter(F.col("i") <= pages)
    lists = early.groupBy("type", "region").agg(F.array_sort(F.collect_list(F.struct("i", "page"))).alias("p")).select("type", "region", F.transform("p", lambda x: x["page"]).alias("pages"))
    # A row for each type and region: a handful.
    place = F.row_number().over(W.orderBy(F.desc("n"), F.col("first")))
    return groups.join(lists, ["type", "region"]).select("type", "region", "n", "pages", place.alias("place"))
