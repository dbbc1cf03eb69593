"""Layout projection: M3, M4, M5, A14, J13, P14."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Height in pixels of roles that are scaled by height; limits of the scale.
TARGET_HEIGHT = {"label": 26, "page_number": 22}
PARAGRAPH_MOST, OTHER_MOST = 3.2, 2.0
# Where an answer page is cut into two columns, and its margins.
GUTTER_ODD, GUTTER_EVEN, MARGIN_LEFT, MARGIN_RIGHT = 0.462, 0.49, 0.05, 0.98
WRAP_WIDTH = 332 / 1073


def widest_line(lines: Column) -> Column:
    """Null without lines. lines: array<struct<x, y, w, h>>."""
    return F.array_max(F.transform(lines, lambda x: x["w"]))


def scaled(blocks: DataFrame, container: float) -> DataFrame:
    """Scale, width and height drawn, offsets of the page picture, centred.

    blocks: role, x, y, w, h of the page, lines, page_w, page_h. By height for labels and page numbers; else
    by the widest line of paragraphs and equations that have lines, or the block's width.
    """
    target = F.coalesce(*(F.when(F.col("role") == r, F.lit(float(v))) for r, v in TARGET_HEIGHT.items()))
    auto = target.isNotNull()
    by_lines = F.col("role").isin("paragraph", "equation") & (F.coalesce(F.size("lines"), F.lit(0)) > 0) & ~auto
    width = F.when(by_lines, widest_line(F.col("lines"))).otherwise(F.col("w"))
    free = F.when(auto, target / (F.col("h") * F.col("page_h"))).otherwise(F.lit(float(container)) / (width * F.col("page_w")))
    most = F.when(F.col("role") == "paragraph", PARAGRAPH_MOST).otherwise(OTHER_MOST)
    sized = blocks.withColumn("scale", F.least(free, most)).withColumn("by_lines", by_lines)
    full_w, full_h = F.col("page_w") * F.col("scale"), F.col("page_h") * F.col("scale")
    return (
        sized.withColumn("draw_w", F.col("w") * full_w).withColumn("draw_h", F.col("h") * full_h)
        .withColumn("offset_x", -F.col("x") * full_w).withColumn("offset_y", -F.col("y") * full_h)
        .withColumn("centred", ~auto & ~by_lines & (F.col("w") * full_w < container))
    )


def answer_columns(pages: DataFrame, splits: DataFrame, container: float, aspect: float) -> DataFrame:
    """M5: two columns of each answer page: x0, x1, the page's drawn size and offset. splits: page, split of those set by hand."""
    default = F.when(F.col("page") % 2 == 1, GUTTER_ODD).otherwise(GUTTER_EVEN)
    cut = pages.join(splits, "page", "left").withColumn("g", F.coalesce("split", default))
    two = F.array(F.struct(F.lit(0).alias("i"), F.lit(MARGIN_LEFT).alias("x0"), F.col("g").alias("x1")), F.struct(F.lit(1).alias("i"), F.col("g").alias("x0"), F.lit(MARGIN_RIGHT).alias("x1")))
    each = cut.select("page", F.explode(two).alias("c")).select("page", "c.*")
    full = F.lit(float(container)) / (F.col("x1") - F.col("x0"))
    return each.withColumn("full_w", full).withColumn("full_h", full * aspect).withColumn("offset_x", -F.col("x0") * full)


def to_wrap(kind: Column, width: Column, n_lines: Column) -> Column:
    """Long single lines of text and formulas."""
    return (width > WRAP_WIDTH) & kind.isin("text", "formula") & (n_lines <= 1)
