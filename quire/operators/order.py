"""Reading order, attachments and set-based edits: O1-O3, W8, W9, J8, J10, J11, A9, A10, U1-U9, U11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import block_id, role_of, trailing_number
from quire.operators.review import flag_outliers

# What may be attached to another block.
ATTACHABLE = ["text", "figure", "formula", "table"]


def reading_keys(half: Column | float = 0.5, row: Column | float = 0.008) -> list[Column]:
    """O1: page numbers last, left column first, rows of y, problem numbers first in a row."""
    return [(F.col("type") == "page_number").cast("int"), (F.col("x") > half).cast("int"), F.bround(F.col("y") / row), (F.col("type") != "problem_number").cast("int")]


def reading_order(blocks: DataFrame, position: str = "ord", half: float = 0.5, row: float = 0.008, out: str = "rank") -> DataFrame:
    """Rank from 0 in each page; blocks that tie keep their previous order."""
    w = W.partitionBy("page").orderBy(*reading_keys(half, row), position)
    return blocks.withColumn(out, F.row_number().over(w) - 1)


def place_attached(blocks: DataFrame, rank: str = "rank", out: str = "place") -> DataFrame:
    """Each attached block right after its target; those without a target in the page that is itself unattached go last.

    blocks: page, id, attach_to (null or empty: none) and the rank they have so far. Input order counts among
    blocks with one target and among those that go last. If ids repeat, the last block of an id is the target.
    """
    target = F.when(F.col("attach_to") != "", F.col("attach_to"))
    b = blocks.withColumn("__t", target)
    roots = b.filter("__t is null").groupBy("page", "id").agg(F.max(rank).alias("__r")).select("page", F.col("id").alias("__t"), "__r")
    met = b.join(roots, ["page", "__t"], "left")
    orphan = F.col("__t").isNotNull() & F.col("__r").isNull()
    w = W.partitionBy("page").orderBy(orphan.cast("int"), F.coalesce("__r", F.col(rank)), F.col("__t").isNotNull().cast("int"), rank)
    return met.withColumn(out, F.row_number().over(w) - 1).drop("__t", "__r")


def save_order(blocks: DataFrame, position: str = "ord", half: float = 0.5, row: float = 0.008, book: str = "book") -> DataFrame:
    """O3: pages ascending in their book, O1 then O2 in each; order from 0 in the page, position_in_book from 0. Page numbers are of one book each."""
    placed = place_attached(reading_order(blocks, position, half, row), out="order")
    sizes = placed.groupBy(book, "page").agg(F.count("*").alias("__n"))
    # One row for each page, so the running total over a book's pages is small.
    before = W.partitionBy(book).orderBy("page").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("page", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    return placed.join(starts, "page").withColumn("position_in_book", F.col("__b") + F.col("order")).drop("__b")


def problem_index(blocks: DataFrame, position: str) -> DataFrame:
    """1-based number of the problem that a block belongs to or is, 0 before the first."""
    w = W.partitionBy("page").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    return blocks.withColumn("problem_index", F.sum((F.col("type") == "problem_number").cast("long")).over(w))


def in_block_order(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages' block_order looked up; unknown ids are left out; of blocks with one id the last (by ord) counts."""
    last = blocks.groupBy("id").agg(F.max_by(F.struct(*blocks.columns), "ord").alias("b"))
    return pages.select("page", F.posexplode("block_order").alias("pos", "id")).join(last, "id").select("page", "pos", "b.*") if "page" not in blocks.columns else pages.select(F.col("page").alias("on_page"), F.posexplode("block_order").alias("pos", "id")).join(last, "id").select("on_page", "pos", "b.*")


def repoint(blocks: DataFrame, mapping: DataFrame) -> DataFrame:
    """attach_to that is an old id becomes the new id, or null where new is null. mapping: old, new."""
    m = mapping.select(F.col("old").alias("attach_to"), F.col("new").alias("__new"), F.lit(True).alias("__hit"))
    return blocks.join(m, "attach_to", "left").withColumn("attach_to", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("attach_to"))).select(blocks.columns)


def next_numbers(blocks: DataFrame) -> DataFrame:
    """A10: per page the largest number at the end of an id, plus one; 0 where no id has one."""
    return blocks.groupBy("page").agg((F.coalesce(F.max(trailing_number(F.col("id"))), F.lit(-1)) + 1).alias("next_number"))


def merge_blocks(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen (page, id) blocks of each page become one: the box around them, the type of the largest (first of equals).

    Its number is that of A10 over what remains. Its pointers, confidence and lines are gone; what pointed to a
    source points to it.
    """
    source = blocks.join(chosen.select("page", "id").distinct(), ["page", "id"], "left_semi")
    rest = blocks.join(chosen.select("page", "id").distinct(), ["page", "id"], "left_anti")
    numbers = chosen.select("page").distinct().join(next_numbers(rest), "page", "left").select("page", F.coalesce("next_number", F.lit(0)).alias("n"))
    box = source.groupBy("page").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
        F.max_by("type", F.struct(F.col("w") * F.col("h"), -F.col("ord"))).alias("type"), F.min("ord").alias("ord"),
    )
    made = box.join(numbers, "page").select("page", block_id(F.col("page"), F.col("n"), "bm").alias("id"), "ord", "type", "x", "y", "w", "h", F.lit(None).cast("string").alias("attach_to"))
    pointers = source.select("page", F.col("id").alias("old")).join(made.select("page", F.col("id").alias("new")), "page").select("old", "new")
    return repoint(rest.select(made.columns), pointers).unionByName(made)


def delete_blocks(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    """U4: without the blocks gone (id), and with pointers to them cleared."""
    left = blocks.join(gone.select("id").distinct(), "id", "left_anti").select(blocks.columns)
    return repoint(left, gone.select(F.col("id").alias("old"), F.lit(None).cast("string").alias("new")).distinct())


def retype(blocks: DataFrame, change: Column, kind: Column) -> DataFrame:
    """Where change holds, the new type and a reflow hint of its role alone, so a pointer goes."""
    return blocks.withColumn("type", F.when(change, kind).otherwise(F.col("type"))).withColumn("role", F.when(change, role_of(kind)).otherwise(F.col("role"))).withColumn("attach_to", F.when(~change, F.col("attach_to")))


def resize(blocks: DataFrame, rects: DataFrame, width: Column, height: Column, least: float = 5) -> DataFrame:
    """Boxes overwritten by pixel rectangles (page, id, px0, py0, px1, py1) as shares of the page, neither rounded nor kept inside it.

    A side that was dragged (edges holds L, R, T or B) stays `least` pixels away from the one across.
    """
    dragged = lambda e: F.col("edges").contains(e)
    x0 = F.when(dragged("L"), F.least("px0", F.col("px1") - least)).otherwise(F.col("px0"))
    x1 = F.when(dragged("R"), F.greatest("px1", x0 + least)).otherwise(F.col("px1"))
    y0 = F.when(dragged("T"), F.least("py0", F.col("py1") - least)).otherwise(F.col("py0"))
    y1 = F.when(dragged("B"), F.greatest("py1", y0 + least)).otherwise(F.col("py1"))
    new = rects.select("page", "id", F.struct((x0 / width).alias("x"), (y0 / height).alias("y"), ((x1 - x0) / width).alias("w"), ((y1 - y0) / height).alias("h")).alias("__r"))
    met = blocks.join(new, ["page", "id"], "left")
    return met.withColumns({c: F.coalesce(F.col(f"__r.{c}"), F.col(c).cast("double")) for c in "xywh"}).select(blocks.columns)


def discard(saved: DataFrame, area: Column, **limits) -> DataFrame:
    """What was saved last, with its review flags worked out anew; edits since are gone."""
    return flag_outliers(saved.drop("needs_review", "area", "median_area"), area, **limits)


def attach(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Links (id, target) set or, with a null target, clear the pointer of attachable blocks; a block is never its own target."""
    m = links.select("id", F.col("target").alias("__target"), F.lit(True).alias("__hit")).filter(F.col("__target").isNull() | (F.col("__target") != F.col("id")))
    ok = F.coalesce(F.col("__hit"), F.lit(False)) & F.col("type").isin(ATTACHABLE)
    return blocks.join(m, "id", "left").withColumn("attach_to", F.when(ok, F.col("__target")).otherwise(F.col("attach_to"))).select(blocks.columns)


def insert_drawn(blocks: DataFrame, drawn: DataFrame) -> DataFrame:
    """Drawn rectangles (page, x, y, w, h) over 5 wide and high become text blocks at the pages' ends, numbered from A10 on."""
    ok = drawn.filter("w > 5 and h > 5").join(next_numbers(blocks), "page", "left")
    place = F.row_number().over(W.partitionBy("page").orderBy("y", "x", "w", "h")) - 1
    last = blocks.groupBy("page").agg(F.max("ord").alias("__o"))
    new = ok.withColumn("__i", place).join(last, "page", "left").select(
        "page", block_id(F.col("page"), F.coalesce("next_number", F.lit(0)) + F.col("__i"), "bn").alias("id"), (F.coalesce("__o", F.lit(-1)) + 1 + F.col("__i")).cast("long").alias("ord"),
        F.lit("text").alias("type"), "x", "y", "w", "h", F.lit(None).cast("string").alias("attach_to"),
    )
    return blocks.select(new.columns).unionByName(new)


def replace_pages(blocks: DataFrame, again: DataFrame) -> DataFrame:
    """Pages analysed again replace those of before."""
    return blocks.join(again.select("page").distinct(), "page", "left_anti").select(again.columns).unionByName(again)


def append_badges(blocks: DataFrame, badges: DataFrame) -> DataFrame:
    """Badges after each page's blocks with numbers that go on; as problem numbers of confidence 0.6, to be reviewed."""
    n = blocks.groupBy("page").agg(F.count("*").alias("__n"))
    i = F.row_number().over(W.partitionBy("page").orderBy("ord")) - 1
    own = badges.withColumn("__i", i).join(n, "page", "left").withColumn("ord", F.coalesce("__n", F.lit(0)) + F.col("__i"))
    shown = own.select("page", block_id(F.col("page"), F.col("ord")).alias("id"), "ord", F.lit("problem_number").alias("type"), "x", "y", "w", "h", F.lit(0.6).alias("confidence"), F.lit(True).alias("needs_review"))
    return blocks.select(shown.columns).unionByName(shown)
