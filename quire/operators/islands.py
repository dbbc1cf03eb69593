"""Gaps and islands over intervals and run-length rows: W1-W6, A7, A8, P3, R5-R11, U2.

Run-length rows are (keys, y, x0, x1): the ink of a page line by line. All work is partitioned by the page, and no
step compares all rows of a page with all of its boxes: rows find their span by one sort, or by buckets of y.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.tables import staged

# Least side and area of a block, and where the chapter badge is; the sidebar's edge and its wider gaps.
LEAST_SIDE, LEAST_AREA, BADGE_X, BADGE_Y = 7, 400, 0.90, 0.35
SIDEBAR_X, SIDEBAR_GAP = 0.65, 2.2
# Least height of a component of a first line, least width of a word; least ink and share of a coloured label.
LETTER_HEIGHT, WORD_WIDTH, LABEL_INK, LABEL_SHARE = 10, 3, 20, 0.6
#: Rows and boxes of a page meet in stretches of so many rows.
STRETCH = 256


def runs(df: DataFrame, keys: list[str], at: str, inside: Column) -> DataFrame:
    """Maximal runs of consecutive positions where inside holds, as half-open [p0, p1). Positions are whole numbers, once per key."""
    ink = df.filter(inside)
    place = F.col(at) - F.row_number().over(W.partitionBy(*keys).orderBy(at))
    return ink.withColumn("__g", place).groupBy(*keys, "__g").agg(F.min(at).alias("p0"), (F.max(at) + 1).alias("p1")).drop("__g")


def merge_gaps(df: DataFrame, keys: list[str], gap: Column, inclusive: bool) -> DataFrame:
    """Intervals [p0, p1) joined while the distance to the one before is below gap, or at most gap where inclusive."""
    w = W.partitionBy(*keys).orderBy("p0")
    distance = F.col("p0") - F.lag("p1").over(w)
    joined = (distance <= gap) if inclusive else (distance < gap)
    marked = df.withColumn("__new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("__island", F.sum("__new").over(w))
    return numbered.groupBy(*keys, "__island").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.count("*").alias("n")).drop("__island")


def density(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows have ink at x, as stretches [p0, p1) of equal d, where there is any; by the ends of runs, not by their pixels."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("p"), F.lit(1).alias("s")), F.struct(F.col("x1").alias("p"), F.lit(-1).alias("s"))))
    steps = rows.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.p").alias("p0")).agg(F.sum("e.s").alias("s"))
    w = W.partitionBy(*keys).orderBy("p0")
    return steps.select(*keys, "p0", F.lead("p0").over(w).alias("p1"), F.sum("s").over(w).alias("d")).filter("d > 0")


def column_runs(density: DataFrame, keys: list[str], height: Column, min_gap: int = 15, share: float = 0.004) -> DataFrame:
    """Columns of a page: stretches [p0, p1) of density d at least max(2, share * height), joined over gaps below min_gap."""
    return merge_gaps(density.filter(F.col("d") >= F.greatest(F.lit(2.0), height * share)), keys, F.lit(min_gap), inclusive=False)


def within(rows: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """rows with the span [p0, p1) of their keys that their position lies in; others are absent. Spans of one key do not overlap."""
    others = [c for c in rows.columns if c not in keys]
    marks = spans.select(*keys, F.col("p0").alias("__at"), F.lit(0).alias("__o"), F.struct("p0", "p1").alias("__span"))
    own = rows.select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__o"), F.struct(*others).alias("__row"))
    w = W.partitionBy(*keys).orderBy("__at", "__o")
    met = own.unionByName(marks, allowMissingColumns=True).withColumn("__span", F.last("__span", True).over(w))
    return met.filter("__row is not null and __at < __span.p1").select(*keys, "__row.*", F.col("__span.p0").alias("p0"), F.col("__span.p1").alias("p1"))


def line_height(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median height of all bands and the gap that joins lines, max(6, int(0.9 * median)); 20 where a page has no band."""
    med = F.coalesce(F.median(F.col("p1") - F.col("p0")), F.lit(20.0))
    return bands.groupBy(*keys).agg(med.alias("median_h")).withColumn("gap", F.greatest(F.lit(6), (F.col("median_h") * 0.9).cast("int")))


def gap_vector(df: DataFrame, keys: list[str]) -> DataFrame:
    """The gap from each component (x0, w) to the next one."""
    w = W.partitionBy(*keys).orderBy("x0", "w", "h")
    return df.withColumn("gap", F.lead("x0").over(w) - (F.col("x0") + F.col("w")))


def first_tall(df: DataFrame, keys: list[str], ratio: float = 1.35, value: str = "i") -> DataFrame:
    """Per key the value (least) of the first band i (from 0) over ratio * max(median of all bands before, 1); keys without one are absent."""
    before = W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    tall = df.withColumn("m", F.percentile("h", F.lit(0.5)).over(before)).filter(F.col("m").isNotNull() & (F.col("h") > ratio * F.greatest(F.col("m"), F.lit(1.0))))
    return tall.groupBy(*keys).agg(F.min(value).alias("split_at"))


def monotone(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is at least that of the last kept row, which is the running maximum of all rows before; it starts at 0."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__m", F.max(value).over(before)).filter(F.col(value) >= F.coalesce("__m", F.lit(0))).drop("__m")


def in_boxes(rows: DataFrame, boxes: DataFrame, keys: list[str], box: list[str]) -> DataFrame:
    """rows (keys, y, x0, x1) cut at the sides of the boxes (keys, box, x0, y0, x1, y1) that they lie in, with the columns box; a row may lie in several."""
    others = [c for c in rows.columns if c not in (*keys, "x0", "x1")]
    stretch = F.explode(F.sequence(F.floor(F.col("y0") / STRETCH), F.floor((F.col("y1") - 1) / STRETCH)))
    b = boxes.filter("y1 > y0").select(*keys, *box, *(F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")), stretch.alias("__s"))
    met = rows.withColumn("__s", F.floor(F.col("y") / STRETCH)).join(b, [*keys, "__s"]).filter("y >= __y0 and y < __y1 and x0 < __x1 and x1 > __x0")
    return met.select(*keys, *box, *others, F.greatest("x0", "__x0").alias("x0"), F.least("x1", "__x1").alias("x1"))


def row_bands(rows: DataFrame, keys: list[str], over: int = 2) -> DataFrame:
    """Bands [p0, p1) of consecutive y whose ink is over `over` pixels."""
    return runs(rows.groupBy(*keys, "y").agg(F.sum(F.col("x1") - F.col("x0")).alias("d")), keys, "y", F.col("d") > over)


def tight(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least x0 and the largest x1 of each key's rows."""
    return rows.groupBy(*keys).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def joined_runs(group: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The 8-connected part of each run (its number): runs of one group that touch, also at a corner, in rows next to each other are of one part."""
    order = np.lexsort((x0, y, group))
    parent = list(range(len(order)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    g, row, left, right = (v[order].tolist() for v in (group, y, x0, x1))
    first = np.flatnonzero(np.append(True, (np.diff(group[order]) != 0) | (np.diff(y[order]) != 0))).tolist() if len(order) else []
    for a, b, c in zip(first, first[1:], [*first[2:], len(order)], strict=False):
        if g[a] != g[b] or row[b] != row[a] + 1:
            continue
        i, j = a, b
        while i < b and j < c:
            if left[i] <= right[j] and left[j] <= right[i]:
                p, q = sorted((find(i), find(j)))
                parent[q] = p
            if right[i] < right[j]:
                i += 1
            else:
                j += 1
    out = np.empty(len(order), np.int64)
    out[order] = [find(i) for i in range(len(order))]
    return out


def run_components(rows: DataFrame, keys: list[str], page: list[str]) -> DataFrame:
    """Keys, x0, y0, w, h, area, tint of each 8-connected part of the rows (keys, y, x0, x1, tint); keys begin with those of the page.

    Pages are streamed whole, many at once; tint is summed like the area.
    """
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema]

    def run(table: pa.Table) -> pa.Table:
        y, x0, x1, tint = (np.asarray(table[c]).astype(np.int64) for c in ("y", "x0", "x1", "tint"))
        group = np.zeros(len(y), np.int64)
        for k in keys:
            codes = np.asarray(table[k].combine_chunks().dictionary_encode().indices).astype(np.int64)
            group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
        part, at, of = np.unique(joined_runs(group, y, x0, x1), return_index=True, return_inverse=True)
        n = len(part)
        left, top = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        right, bottom, area, hue = (np.zeros(n, np.int64) for _ in range(4))
        np.minimum.at(left, of, x0)
        np.minimum.at(top, of, y)
        np.maximum.at(right, of, x1)
        np.maximum.at(bottom, of, y + 1)
        np.add.at(area, of, x1 - x0)
        np.add.at(hue, of, tint)
        made = table.select(keys).take(pa.array(at))
        for name, v in (("x0", left), ("y0", top), ("w", right - left), ("h", bottom - top), ("area", area), ("tint", hue)):
            made = made.append_column(name, pa.array(v))
        return made

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b])
            held = table if held is None else pa.concat_tables([held, table])
            if not len(held):
                continue
            # The last page may go on in the next batch.
            last = [held[k][-1] for k in page]
            same = np.logical_and.reduce([np.asarray(pc.fill_null(pc.equal(held[k], v), False)) if v.is_valid else np.asarray(held[k].is_null()) for k, v in zip(page, last, strict=True)])
            cut = int(same.argmax())
            if cut:
                yield from run(held.slice(0, cut)).combine_chunks().to_batches()
                held = held.slice(cut)
        if held is not None and len(held):
            yield from run(held).combine_chunks().to_batches()

    together = rows.select(*keys, "y", "x0", "x1", "tint").repartition(*page).sortWithinPartitions(*page)
    return together.mapInArrow(stream, ", ".join([*names, "x0 long, y0 long, w long, h long, area long, tint long"]))


def debris(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Sides or area below the least ones, or the chapter badge in the upper right corner."""
    w, h = x1 - x0, y1 - y0
    return (w < LEAST_SIDE) | (h < LEAST_SIDE) | (w * h < LEAST_AREA) | ((x0 / width > BADGE_X) & (y1 / height < BADGE_Y))


def _clean(boxes: DataFrame, size: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.join(size, keys).filter(~debris(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "width", "height"))))


def label_pieces(boxes: DataFrame, comps: DataFrame, keys: list[str]) -> DataFrame:
    """U2 by R11, else R10: boxes (keys, x0, y0, x1, y1, l1: end of the first line) whose first line begins with a label, as label (piece 0) and rest (piece 1); others whole (piece 1).

    comps: components of first lines (keys, x0, w, h, area, tint).
    """
    found = comps.filter(F.col("h") >= LETTER_HEIGHT).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x0", "w", "h", "area", "tint"))).alias("c"))
    met = boxes.join(found, keys, "left")
    one, two = F.get("c", 0), F.get("c", 1)
    coloured = F.coalesce((F.size("c") >= 2) & (one["area"] >= LABEL_INK) & (one["tint"] > LABEL_SHARE * one["area"]), F.lit(False))
    spaced = F.coalesce(label_split(F.col("c")), F.lit(False))
    label = F.struct(F.lit(0).alias("piece"), F.when(coloured, one["x0"]).otherwise(F.col("x0")).alias("x0"), "y0", (one["x0"] + one["w"]).alias("x1"), F.col("l1").alias("y1"))
    rest = F.struct(F.lit(1).alias("piece"), two["x0"].alias("x0"), "y0", "x1", "y1")
    whole = F.struct(F.lit(1).alias("piece"), "x0", "y0", "x1", "y1")
    return met.select(*keys, F.explode(F.when(coloured | spaced, F.array(label, rest)).otherwise(F.array(whole))).alias("b")).select(*keys, "b.*")


def tall_pieces(boxes: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """U2 by W5: boxes (keys, x0, y0, x1, y1) with a line much taller than those before are cut above it, and both halves tightened."""
    bands = row_bands(rows, keys).withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy("p0")) - 1).withColumn("h", F.col("p1") - F.col("p0"))
    cut = first_tall(bands, keys, value="p0")
    sides = tight(rows.join(cut, keys).withColumn("low", F.col("y") >= F.col("split_at")), [*keys, "low"]).withColumnsRenamed({"x0": "tx0", "x1": "tx1"})
    top = F.struct(F.lit(False).alias("low"), F.col("y0"), F.col("split_at").alias("y1"))
    bottom = F.struct(F.lit(True).alias("low"), F.col("split_at").alias("y0"), F.col("y1"))
    whole = F.struct(F.lit(None).cast("boolean").alias("low"), F.col("y0"), F.col("y1"))
    met = boxes.join(cut, keys, "left").select(*keys, "x0", "x1", F.explode(F.when(F.col("split_at").isNotNull(), F.array(top, bottom)).otherwise(F.array(whole))).alias("b"))
    met = met.select(*keys, "x0", "x1", "b.*").join(sides, [*keys, "low"], "left")
    return met.select(*keys, F.coalesce("tx0", "x0").alias("x0"), "y0", F.coalesce("tx1", "x1").alias("x1"), "y1")


def text_blocks(rle: DataFrame, size: DataFrame, keys: list[str]) -> DataFrame:
    """R7 from the closed mask on: padded boxes of a page's blocks, from run-length rows (keys, y, x0, x1, and tint: pixels in the colour of problem numbers).

    size: keys, width, height of each page. Steps: columns (A7, W2), lines (W1), the joining gap (A8, P11, P5, W3), tight
    boxes (R6), debris (P3), leading labels by colour (R11) or gap (R10), tall lines (W5), debris again, padding (P2).
    """
    if "tint" not in rle.columns:
        rle = rle.withColumn("tint", F.lit(0).cast("long"))
    cols = column_runs(density(rle, keys).join(size, keys), keys, F.col("height"), 20).select(*keys, F.col("p0").alias("c0"), F.col("p1").alias("c1"))
    column = [*keys, "c0"]
    # A page has few columns.
    cut = rle.join(cols, keys).filter("x0 < c1 and x1 > c0").select(*column, "y", F.greatest("x0", "c0").alias("x0"), F.least("x1", "c1").alias("x1"), "tint")
    bands = row_bands(cut, column)
    measured = bands.join(line_height(bands, keys), keys).join(size, keys).filter("p1 - p0 >= 3")
    gap = F.when(F.col("c0") / F.col("width") > SIDEBAR_X, (F.col("gap") * SIDEBAR_GAP).cast("int")).otherwise(F.col("gap"))
    blocks = merge_gaps(measured.withColumn("gap", gap), column, F.col("gap"), inclusive=True)
    block = [*column, "b0"]
    rows = staged(within(cut, blocks, column, "y").withColumnsRenamed({"p0": "b0", "p1": "b1"}), "block-rows")
    boxes = _clean(tight(rows, [*block, "b1"]).select(*block, "x0", F.col("b0").alias("y0"), "x1", F.col("b1").alias("y1")), size, keys)
    # A block begins with its first line.
    lines = row_bands(rows, column).select(*column, F.col("p0").alias("b0"), F.col("p1").alias("l1"))
    boxes = boxes.join(lines, block).select(*block, "x0", "y0", "x1", "y1", "l1")
    first = rows.join(boxes.select(*block, "l1"), block).filter("y < l1").select(*block, "y", "x0", "x1", "tint")
    pieces = staged(label_pieces(boxes, run_components(first, block, keys), block), "pieces")
    sides = pieces.select(*block, "piece", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    own = rows.join(sides, block).filter("y >= by0 and y < by1 and x0 < bx1 and x1 > bx0").select(*block, "piece", "y", F.greatest("x0", "bx0").alias("x0"), F.least("x1", "bx1").alias("x1"))
    kept = _clean(tall_pieces(pieces, own, [*block, "piece"]), size, keys)
    by = 3
    return kept.select(
        *keys, F.greatest(F.lit(0), F.col("x0") - by).cast("long").alias("x0"), F.greatest(F.lit(0), F.col("y0") - by).cast("long").alias("y0"),
        F.least("width", F.col("x1") + by).cast("long").alias("x1"), F.least("height", F.col("y1") + by).cast("long").alias("y1"),
    )


def lines_in_boxes(rle: DataFrame, boxes: DataFrame, keys: list[str], box: list[str]) -> DataFrame:
    """Keys, box, x0, y0, x1, y1 of each line in each box: bands of at least three rows, with tight sides."""
    group = [*keys, *box]
    rows = in_boxes(rle.select(*keys, "y", "x0", "x1"), boxes, keys, box)
    bands = row_bands(rows, group).filter("p1 - p0 >= 3")
    return tight(within(rows, bands, group, "y"), [*group, "p0", "p1"]).select(*group, "x0", F.col("p0").alias("y0"), "x1", F.col("p1").alias("y1"))


def wrapped_lines(rle: DataFrame, lines: DataFrame, keys: list[str], line: list[str], long: Column) -> DataFrame:
    """Lines (keys, line, x0, y0, x1, y1) where long holds, wrapped by wrap_at over their words (parts of the rows at least WORD_WIDTH wide): halves (half 0 and 1), one tightened box, or as they are."""
    group = [*keys, *line]
    wide = lines.filter(long)
    rows = in_boxes(rle.select(*keys, "y", "x0", "x1"), wide, keys, line).withColumn("tint", F.lit(0).cast("long"))
    words = run_components(rows, group, keys).filter(F.col("w") >= WORD_WIDTH)
    comps = words.join(wide.select(*group, F.col("x0").alias("bx0")), group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct((F.col("x0") - F.col("bx0")).alias("x0"), "w", "h"))).alias("c"))
    met = lines.join(comps, group, "left").withColumn("r", wrap_at(F.col("c"), F.col("x1") - F.col("x0")))
    box = lambda half, a, b: F.struct(F.lit(half).alias("half"), a.alias("x0"), b.alias("x1"))
    x0, x1, a, b = F.col("x0"), F.col("x1"), F.col("x0") + F.col("r.a"), F.col("x0") + F.col("r.b")
    made = F.when(F.col("r.kind") == "split", F.array(box(0, x0, a), box(1, a, x1))).when(F.col("r.kind") == "tight", F.array(box(0, a, b))).otherwise(F.array(box(0, x0, x1)))
    return met.select(*group, "y0", "y1", F.explode(made).alias("m")).select(*group, "m.half", "m.x0", "y0", "m.x1", "y1")


# Component arrays: array<struct<x0, w, h>>, ascending.


def label_split(comps: Column, least_gap: int = 15, ratio: float = 2.2) -> Column:
    """True if there are three components or more and the first gap is at least least_gap and ratio * max(median of the others, 1)."""
    n = F.size(comps)
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(comps, i)["x0"] - (F.get(comps, i - 1)["x0"] + F.get(comps, i - 1)["w"]))
    rest = F.array_sort(F.slice(gaps, F.lit(2), F.greatest(n - 2, F.lit(0))))
    k = F.size(rest)
    mid = (F.get(rest, F.floor((k - 1) / 2).cast("int")) + F.get(rest, F.floor(k / 2).cast("int"))) / 2.0
    return F.coalesce((n >= 3) & (F.get(gaps, 0) >= least_gap) & (F.get(gaps, 0) >= ratio * F.greatest(mid, F.lit(1.0))), F.lit(False))


def wrap_at(comps: Column, box_width: Column, least_gap: int = 4) -> Column:
    """struct(kind, a, b) for a line's components, relative to the box.

    "none" with fewer than two components or no gap of least_gap; "tight" [a, b) where ink spans under half of the
    box; else "split" at a: the middle of the gap nearest to the ink's centre, the first of equally near ones.
    """
    n = F.size(comps)
    left, right = F.get(comps, 0)["x0"], F.get(comps, n - 1)["x0"] + F.get(comps, n - 1)["w"]
    middle = (left + right) / 2
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((F.get(comps, i - 1)["x0"] + F.get(comps, i - 1)["w"]).alias("s"), F.get(comps, i)["x0"].alias("e"), i.alias("i")))
    wide = F.filter(ends, lambda g: g["e"] - g["s"] >= least_gap)
    best = F.array_min(F.transform(wide, lambda g: F.struct(F.abs((g["s"] + g["e"]) / 2 - middle).alias("d"), g["i"].alias("i"), F.floor((g["s"] + g["e"]) / 2).cast("long").alias("at"))))
    none = F.struct(F.lit("none").alias("kind"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    return (
        F.when(n < 2, none)
        .when((box_width > 0) & ((right - left) / box_width < 0.5), F.struct(F.lit("tight").alias("kind"), left.cast("long").alias("a"), right.cast("long").alias("b")))
        .when(F.size(wide) > 0, F.struct(F.lit("split").alias("kind"), best["at"].alias("a"), F.lit(None).cast("long").alias("b")))
        .otherwise(none)
    )
