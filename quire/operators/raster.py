"""Pixel operators: R1-R3, R5, R12, R13, P4, P12, P13, A15, W11, Otsu's threshold; in numpy for one picture, and for frames of pictures.

Colours of pixels are columns; what needs a pixel's neighbours takes pictures (key, width, height, pixels in reading order)
one by one from Arrow batches.

They follow the public definitions (8-connectivity, rectangular closing, HSV with hue 0..180). Parity with
an imaging library in ties and rounding could not be verified here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# Hue, saturation and value of badges and of problem numbers; grey level of ink; least ink and share.
BADGE = {"hue": (85, 125), "saturation": (60, 255), "value": (40, 250)}
NUMBER = {"hue": (145, 172), "saturation": (50, 255), "value": (60, 210)}
INK_GREY, LEAST_INK, LEAST_SHARE = 180, 20, 0.6
# Weights of blue, green and red.
WEIGHTS = (1868, 9617, 4899)
# A badge's area, height and width; the corner that has none; the reach, gap and border of its number.
AREA, HEIGHT, WIDTH, CORNER = (1000, 4000), (30, 70), 90, (0.80, 0.20)
REACH, GAP, BORDER = 80, 15, 6


def otsu_threshold(pixels: np.ndarray) -> int:
    """The level t that separates <= t from > t with the largest variance between both; the first of equals."""
    n = np.bincount(pixels.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(invalid="ignore", divide="ignore"):
        score = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nan_to_num(score).argmax())


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected parts, numbered by their first pixel in reading order; 0 elsewhere."""
    h, w = mask.shape
    labels = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        padded = np.pad(np.where(labels > 0, labels, h * w + 1), 1, constant_values=h * w + 1)
        least = np.min([padded[i : i + h, j : j + w] for i in range(3) for j in range(3)], 0)
        new = np.where(labels > 0, least, 0)
        # pointer jumping: a label's own pixel may have found a smaller one
        flat = np.concatenate(([0], new.ravel()))
        new = np.where(new > 0, flat[new], 0)
        if (new == labels).all():
            break
        labels = new
    names = np.unique(labels[labels > 0])
    return np.where(labels > 0, np.searchsorted(names, labels) + 1, 0)


def stats(labels: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, w, h, area) of each part."""
    y, x = np.nonzero(labels)
    of, n = labels[y, x] - 1, int(labels.max()) if labels.size else 0
    low, high = np.full((2, n), max(labels.shape, default=0)), np.full((2, n), -1)
    for i, v in enumerate((x, y)):
        np.minimum.at(low[i], of, v)
        np.maximum.at(high[i], of, v)
    return list(zip(*low.tolist(), *(high - low + 1).tolist(), np.bincount(of, minlength=n).tolist(), strict=True))


def ink_mask(gray: np.ndarray, least_area: int = 4) -> np.ndarray:
    """Dark pixels by Otsu's level, without parts below least_area."""
    mask = gray <= otsu_threshold(gray)
    labels = components(mask)
    size = np.bincount(labels.ravel())
    return mask & (size[labels] >= least_area)


def rectangle(width: int, height: int) -> np.ndarray:
    return np.ones((height, width), bool)


def ellipse(width: int, height: int) -> np.ndarray:
    """The ellipse in a rectangle of odd sides: of each row, what is at most rint(half width * sqrt(1 - (dy / half height)^2)) off the middle."""
    across, down = width // 2, height // 2
    dy = np.arange(height) - down
    reach = np.rint(across * np.sqrt(1 - (dy / max(down, 1)) ** 2))
    return np.abs(np.arange(width) - across)[None] <= reach[:, None]


def closed(mask: np.ndarray, kernel: np.ndarray | int, height: int | None = None) -> np.ndarray:
    """R2: closing with a kernel of odd sides, or a rectangle of that width and height; outside counts as not set when growing, as set when shrinking."""
    kernel = rectangle(kernel, height or kernel) if isinstance(kernel, int) else kernel
    h, w = kernel.shape
    places = list(zip(*np.nonzero(kernel), strict=True))

    def slide(m: np.ndarray, fill: bool, f) -> np.ndarray:
        p = np.pad(m, ((h // 2,) * 2, (w // 2,) * 2), constant_values=fill)
        out = np.full(m.shape, f)
        for i, j in places:
            part = p[i : i + m.shape[0], j : j + m.shape[1]]
            out = out & part if f else out | part
        return out

    return slide(slide(mask, False, False), True, True) if mask.size else mask


def blanked(mask: np.ndarray, boxes: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Without what is in the boxes (x0, y0, x1, y1)."""
    out = mask.copy()
    for x0, y0, x1, y1 in boxes:
        out[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)] = False
    return out


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue 0..180, saturation and value 0..255."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = np.where(v > low, v - low, 1)
    hue = np.select([v == low, v == r, v == g], [0, 60 * (g - b) / d, 120 + 60 * (b - r) / d], 240 + 60 * (r - g) / d)
    return np.stack([np.rint(np.where(hue < 0, hue + 360, hue) / 2), np.rint(np.where(v > 0, 255 * (v - low) / np.where(v > 0, v, 1), 0)), v], -1).astype(int)


def _tinted(bgr: np.ndarray, limits: dict) -> np.ndarray:
    h, s, v = np.moveaxis(hsv(bgr), -1, 0)
    return np.logical_and.reduce([(low <= c) & (c <= high) for c, (low, high) in zip((h, s, v), limits.values(), strict=True)])


def number_coloured(bgr: np.ndarray) -> bool:
    """Of at least LEAST_INK dark pixels over LEAST_SHARE have the colour of problem numbers."""
    ink = grey(bgr) < INK_GREY
    return bool(ink.sum() >= LEAST_INK and _tinted(bgr, NUMBER)[ink].mean() > LEAST_SHARE)


def grey(bgr: np.ndarray) -> np.ndarray:
    """Whole grey levels by the usual weights in fourteen binary places."""
    return (bgr.astype(int) @ np.array(WEIGHTS) + 8192) >> 14


def badge_shaped(x: int, y: int, w: int, h: int, area: int, page: tuple[int, int], areas: tuple = AREA, heights: tuple = HEIGHT, widest: int = WIDTH) -> bool:
    """Of a badge's size and not in the upper right corner. page: width and height."""
    return areas[0] <= area <= areas[1] and heights[0] <= h <= heights[1] and w <= widest and not (x / page[0] > CORNER[0] and y / page[1] < CORNER[1])


def badges(bgr: np.ndarray, kernel: np.ndarray | int = 17, **limits) -> list[tuple[int, int, int, int]]:
    """R12 without numbers, P12, P13: (x0, y0, x1, y1) of parts in the badges' colour, closed by an ellipse (or a kernel), of a badge's shape."""
    mask = closed(_tinted(bgr, BADGE), ellipse(kernel, kernel) if isinstance(kernel, int) else kernel)
    page = (mask.shape[1], mask.shape[0])
    return [(x, y, x + w, y + h) for x, y, w, h, a in stats(components(mask)) if badge_shaped(x, y, w, h, a, page, **limits)]


def extended(ink_columns: np.ndarray, gap: int = GAP, limit: int = REACH, ignore: int = BORDER) -> int:
    """How far to the right of a badge its number reaches: past the last column with ink, over gaps of at most gap, within limit; the first columns do not count, and the first ink may be anywhere."""
    last = 0
    for x in np.flatnonzero(ink_columns[:limit]).tolist():
        if x < ignore:
            continue
        if last and x - last > gap:
            break
        last = x + 1
    return last


def icon_badges(bgr: np.ndarray, kernel: np.ndarray | int = 17, reach: tuple[int, int, int] = (GAP, REACH, BORDER), **limits) -> list[tuple[int, int, int, int]]:
    """Badges, each up to the end of the number at its right."""
    ink = ink_mask(grey(bgr))
    return [(x0, y0, x1 + extended(ink[y0:y1, x1:].any(0), *reach), y1) for x0, y0, x1, y1 in badges(bgr, kernel, **limits)]


def _pictures(df: DataFrame, key: str, f: Callable[[np.ndarray], list[tuple]], schema: str, names: list[str], channels: int = 1, others: tuple[str, ...] = ()) -> DataFrame:
    """key and the rows that f makes of each picture."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, made = [], []
            columns = [b.column(c).to_pylist() for c in ("width", "height", "pixels", *others)]
            for i, (w, h, pixels, *more) in enumerate(zip(*columns, strict=True)):
                picture = np.array(pixels, np.int64).reshape((h, w, channels) if channels > 1 else (h, w))
                rows = f(picture, *more)
                at += [i] * len(rows)
                made += rows
            cells = list(zip(*made, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cells, _kinds(schema), strict=True))], [key, *names])

    return df.select(key, "width", "height", "pixels", *others).mapInArrow(run, f"`{key}` {kind}, {schema}")


def _kinds(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return [kinds[part.split()[1]] for part in schema.split(", ")]


def bits(mask: np.ndarray) -> str:
    return "".join(map(str, mask.astype(int).ravel().tolist()))


def ink_masks(pictures: DataFrame, key: str = "id", least_area: int = 4) -> DataFrame:
    """Key and mask (a digit for each pixel in reading order, 1 for ink) of grey pictures."""
    return _pictures(pictures, key, lambda x: [(bits(ink_mask(x, least_area)),)], "mask string", ["mask"])


def closed_masks(pictures: DataFrame, kernels: dict[str, np.ndarray], key: str = "id") -> DataFrame:
    """The ink of grey pictures closed by each kernel, as columns of their names."""
    return _pictures(pictures, key, lambda x: [tuple(bits(closed(ink_mask(x), k)) for k in kernels.values())], ", ".join(f"{n} string" for n in kernels), list(kernels))


def blanked_masks(pictures: DataFrame, key: str = "id", boxes: str = "boxes") -> DataFrame:
    """The ink of grey pictures without what is in their boxes (array of x0, y0, x1, y1)."""
    return _pictures(pictures, key, lambda x, b: [(bits(blanked(ink_mask(x), [(r["x0"], r["y0"], r["x1"], r["y1"]) for r in b])),)], "mask string", ["mask"], others=(boxes,))


def ink_parts(pictures: DataFrame, key: str = "id") -> DataFrame:
    """Key, x, y, w, h, area of each 8-connected part of the ink of grey pictures."""
    return _pictures(pictures, key, lambda x: stats(components(ink_mask(x))), "x long, y long, w long, h long, area long", ["x", "y", "w", "h", "area"])


def picture_badges(pictures: DataFrame, key: str = "id", kernel: np.ndarray | int = 17, reach: tuple[int, int, int] = (GAP, REACH, BORDER), **limits) -> DataFrame:
    """Key, x0, y0, x1, y1 of the badges of pictures (pixels: blue, green, red of each)."""
    return _pictures(pictures, key, lambda x: icon_badges(x, kernel, reach, **limits), "x0 long, y0 long, x1 long, y1 long", ["x0", "y0", "x1", "y1"], channels=3)


def crops(pictures: DataFrame, key: str = "id", box: str = "box") -> DataFrame:
    """R13 without its encoding: key and image: the bytes of a box (x0, y0, x1, y1) of each picture, in reading order."""
    return _pictures(pictures, key, lambda x, b: [(x[b["y0"] : b["y1"], b["x0"] : b["x1"]].astype(np.uint8).tobytes(),)], "image binary", ["image"], others=(box,))


def hsv_columns(blue: Column, green: Column, red: Column) -> tuple[Column, Column, Column]:
    """Hue 0..180, saturation and value 0..255, as hsv() has them."""
    b, g, r = (c.cast("double") for c in (blue, green, red))
    v, low = F.greatest(b, g, r), F.least(b, g, r)
    d = F.when(v > low, v - low).otherwise(F.lit(1.0))
    hue = F.when(v == low, F.lit(0.0)).when(v == r, 60 * (g - b) / d).when(v == g, 120 + 60 * (b - r) / d).otherwise(240 + 60 * (r - g) / d)
    return F.rint(F.when(hue < 0, hue + 360).otherwise(hue) / 2).cast("int"), F.rint(F.when(v > 0, 255 * (v - low) / v).otherwise(F.lit(0.0))).cast("int"), v.cast("int")


def colour_shares(pixels: DataFrame, keys: list[str], limits: dict = NUMBER) -> DataFrame:
    """Keys, ink, share, coloured: the dark pixels (blue, green, red) of each key, the share of them in a colour, and whether they are enough. Combined before the shuffle."""
    tint = hsv_columns(F.col("blue"), F.col("green"), F.col("red"))
    hit = tint[0].between(*limits["hue"]) & tint[1].between(*limits["saturation"]) & tint[2].between(*limits["value"])
    level = F.shiftright(sum((F.col(c).cast("long") * w for c, w in zip(("blue", "green", "red"), WEIGHTS, strict=True)), F.lit(8192)), 14)
    dark = level < INK_GREY
    sums = pixels.groupBy(*keys).agg(F.sum(dark.cast("long")).alias("ink"), F.sum((dark & hit).cast("long")).alias("__hit"))
    share = F.when(F.col("ink") > 0, F.col("__hit") / F.col("ink")).otherwise(F.lit(0.0))
    return sums.withColumn("share", share).withColumn("coloured", (F.col("ink") >= LEAST_INK) & (F.col("share") > LEAST_SHARE)).drop("__hit")


def otsu_levels(pixels: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """R1's threshold from rows of pixels, by one aggregate: at most 256 rows for each key reach the windows."""
    counts = pixels.groupBy(*keys, level).agg(F.count("*").alias("n"))
    up = W.partitionBy(*keys).orderBy(level).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*keys)
    below, sums = F.sum("n").over(up), F.sum(F.col("n") * F.col(level)).over(up)
    all_n, all_s = F.sum("n").over(whole), F.sum(F.col("n") * F.col(level)).over(whole)
    found = counts.select(*keys, F.col(level), below.alias("b"), sums.alias("s"), all_n.alias("an"), all_s.alias("as_"))
    above: Column = F.col("an") - F.col("b")
    score = F.when(above > 0, F.col("b") * above * F.pow(F.col("s") / F.col("b") - (F.col("as_") - F.col("s")) / above, F.lit(2.0))).otherwise(F.lit(0.0))
    return found.withColumn("score", score).groupBy(*keys).agg(F.max_by(level, F.struct("score", -F.col(level))).alias("threshold"))
