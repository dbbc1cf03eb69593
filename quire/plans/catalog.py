"""Queries by name over the driver's tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geom
from quire.functions import text as tx
from quire.operators import answers, classify, diff, islands, layout, order, raster, review, state
from quire.plans import surrogates as s
from quire.sources import documents as docs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query of its name; whole numbers come out as long."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("long") for c, t in df.dtypes if t in ("int", "smallint", "tinyint")})

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def _iou(a: str, b: str) -> str:
    w = f"(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x))"
    h = f"(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    return f"(CASE WHEN {w} > 0 AND {h} > 0 THEN ({w} * {h}) / ({a}.w * {a}.h + {b}.w * {b}.h - {w} * {h}) ELSE 0.0 END)"


def _greedy(auto: str, edited: str) -> str:
    """CTEs that walk each page's automatic blocks in order; the last is matches (page, a_id, e_id, iou)."""
    return f"""cand AS (SELECT a.page, a.ord AS a_ord, a.id AS a_id, e.ord AS e_ord, e.id AS e_id, {_iou("a", "e")} AS iou FROM {auto} a JOIN {edited} e ON a.page = e.page),
lists AS (SELECT page, a_ord, a_id, list({{'neg': -iou, 'o': e_ord, 'e': e_id}} ORDER BY -iou, e_ord) AS c FROM cand WHERE iou >= 0.5 GROUP BY ALL),
steps AS (SELECT page, a_id, c, row_number() OVER (PARTITION BY page ORDER BY a_ord) AS k FROM lists),
walk AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS a_id, CAST(NULL AS BIGINT) AS e_id, CAST(NULL AS DOUBLE) AS iou FROM steps
  UNION ALL
  SELECT page, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.e) END, a_id, pick.e, -pick.neg
  FROM (SELECT s.page, s.k, w.used, s.a_id, list_filter(s.c, lambda q: NOT list_contains(w.used, q.e))[1] AS pick FROM walk w JOIN steps s ON s.page = w.page AND s.k = w.k + 1)
), matches AS (SELECT page, a_id, e_id, iou FROM walk WHERE e_id IS NOT NULL)"""


# Review -----------------------------------------------------------------------------------------------


@query(f"""WITH {s.BLOCKS}, m AS (SELECT *, w * h AS area, CAST(median(w * h) OVER (PARTITION BY page, type) AS DOUBLE) AS median_area FROM blocks)
SELECT page, id, type, area, median_area, area > 2.5 * greatest(median_area, 1.0) AS needs_review FROM m""")
def review_flags(spark, sf):
    """A1, M2: the flagship: blocks much larger than the median of their page and type."""
    return review.flag_outliers(s.blocks(spark, sf), geom.area(geom.box()), least=1.0).select("page", "id", "type", "area", "median_area", "needs_review")


@query(f"WITH {s.BLOCKS} SELECT page, type, count(*) AS n FROM blocks GROUP BY page, type")
def type_counts(spark, sf):
    """A2."""
    return review.counts(s.blocks(spark, sf), "page", "type")


@query(f"WITH {s.BLOCKS} SELECT page, type, count(*) AS n FROM blocks GROUP BY ROLLUP (page, type)")
def type_counts_rollup(spark, sf):
    """A2: with totals."""
    return s.blocks(spark, sf).rollup("page", "type").agg(F.count("*").alias("n"))


@query(f"""WITH {s.BLOCKS}, m AS (SELECT *, w * h > 2.5 * greatest(median(w * h) OVER (PARTITION BY page, type), 1.0) AS f FROM blocks)
SELECT page, count(*) AS n_blocks, count(*) FILTER (f) AS n_review, count(*) FILTER (f) / count(*) AS ratio FROM m GROUP BY page""")
def review_ratio(spark, sf):
    """A3, A16."""
    return review.page_review(review.flag_outliers(s.blocks(spark, sf), geom.area(geom.box()), least=1.0))


_UNITS = "units AS (SELECT * FROM (VALUES " + ", ".join(f"('{u}', '{t}', CAST({a} AS BIGINT), CAST({b} AS BIGINT))" for u, t, a, b in answers.UNITS) + ") v(unit, title, start_page, end_page))"


@query(f"""WITH {s.BLOCKS}, {_UNITS}, flagged AS (SELECT DISTINCT page FROM (SELECT page, id, w * h > 2.5 * greatest(median(w * h) OVER (PARTITION BY page, type), 1.0) AS f FROM blocks) WHERE f AND id % 9 = 4)
SELECT u.unit, c.page AS current, arg_min(f.page, (f.page - c.page - 1 + (u.end_page - u.start_page + 1)) % (u.end_page - u.start_page + 1)) AS next_page
FROM (SELECT DISTINCT page FROM blocks) c JOIN units u ON c.page BETWEEN u.start_page AND u.end_page LEFT JOIN flagged f ON f.page BETWEEN u.start_page AND u.end_page GROUP BY u.unit, c.page""")
def next_review_page(spark, sf):
    """From every page of every unit (a reader has looked at eight of nine flagged blocks, so that pages without flags are left)."""
    flagged = review.flag_outliers(s.blocks(spark, sf), geom.area(geom.box()), least=1.0).withColumn("needs_review", F.col("needs_review") & (F.col("id") % 9 == 4))
    current = s.blocks(spark, sf).select(F.col("page").alias("current")).distinct()
    return review.next_page(flagged, answers.units(spark), current)


_STATUS = "st AS (SELECT page, CASE WHEN max(id % 3) = 2 AND page % 4 <> 0 THEN 'done' ELSE 'pending' END AS status FROM blocks WHERE page % 5 <> 0 GROUP BY page)"


def _status(spark, sf):
    """Every fifth page has no status."""
    b = s.blocks(spark, sf).filter("page % 5 <> 0").groupBy("page").agg(F.max(F.col("id") % 3).alias("m"))
    return b.select("page", F.when((F.col("m") == 2) & (F.col("page") % 4 != 0), "done").otherwise("pending").alias("status"))


@query(f"""WITH {s.BLOCKS}, {_STATUS}, p AS (SELECT DISTINCT page FROM blocks)
SELECT 'done' AS filter, page FROM p JOIN st USING (page) WHERE status = 'done' UNION ALL SELECT '10-24', page FROM p WHERE page BETWEEN 10 AND 24
UNION ALL SELECT 'pending', page FROM p LEFT JOIN st USING (page) WHERE coalesce(status, '') <> 'done'""")
def page_filters(spark, sf):
    """Pages that are done, in a range, and not done."""
    pages, status = s.blocks(spark, sf).select("page").distinct(), _status(spark, sf)
    each = [review.chosen_pages(pages, status, w).select(F.lit(w).alias("filter"), "page") for w in ("done", "10-24", "pending")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""WITH {s.BLOCKS}, d AS (SELECT page // 100 AS book, id % 7 + 0.5e0 AS seconds FROM blocks WHERE page % 3 = 0 AND page >= 100),
t AS (SELECT page // 100 AS book, count(*) AS total FROM blocks GROUP BY 1), f AS (SELECT book, count(*) AS finished, avg(seconds) AS mean FROM d GROUP BY 1)
SELECT book, total, coalesce(finished, 0) AS finished, round(mean * (total - coalesce(finished, 0)), 6) AS seconds_left FROM t LEFT JOIN f USING (book)""")
def time_left(spark, sf):
    """Blocks of books of a hundred pages, of which every third page is classified."""
    b = s.blocks(spark, sf).withColumn("book", F.expr("page div 100"))
    done = b.filter("page % 3 = 0 AND page >= 100").select("book", (F.col("id") % 7 + 0.5).alias("seconds"))
    return review.remaining(b, done).withColumn("seconds_left", F.round("seconds_left", 6))


# Order ------------------------------------------------------------------------------------------------

_KEYS = "type = 'page_number', x > 500, round_even(y / 8, 0), type <> 'problem_number'"


@query(f"WITH {s.BLOCKS} SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY {_KEYS}, ord) - 1 AS rank FROM blocks")
def reading_order(spark, sf):
    """O1, W9."""
    return order.reading_order(s.blocks(spark, sf), half=500, row=8).select("page", "id", "rank")


def _attached(spark, sf):
    """D1 with pointers: to the block before, to one that is gone, to itself; ids are texts."""
    b = s.blocks(spark, sf)
    target = F.when((F.col("id") % 5 == 2) & F.col("type").isin(order.ATTACHABLE), F.when(F.col("id") % 35 == 2, F.lit(-1)).when(F.col("id") % 35 == 7, F.col("id")).otherwise(F.col("id") - 1))
    return b.select("page", tx.block_id(F.col("page"), F.col("id")).alias("id"), "ord", "type", "x", "y", "w", "h", tx.block_id(F.col("page"), target).alias("attach_to")).withColumn("attach_to", F.when(F.col("attach_to").contains("null"), None).otherwise(F.col("attach_to")))


_ID = "'p' || page || '_b' || lpad(CAST({0} AS VARCHAR), CAST(greatest(2, length(CAST({0} AS VARCHAR))) AS INTEGER), '0')"
_ATTACHED = f"""attached AS (SELECT page, {_ID.format('id')} AS id, ord, type, x, y, w, h, CASE WHEN id % 5 = 2 AND type IN ('text', 'figure', 'formula', 'table')
    THEN CASE WHEN id % 35 = 2 THEN 'p' || page || '_b-1' WHEN id % 35 = 7 THEN {_ID.format('id')} ELSE {_ID.format('(id - 1)')} END END AS attach_to FROM blocks)"""
_PLACED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {_KEYS}, ord) - 1 AS rank FROM attached),
placed AS (SELECT b.*, row_number() OVER (PARTITION BY b.page ORDER BY (b.attach_to IS NOT NULL AND t.rank IS NULL), coalesce(t.rank, b.rank), b.attach_to IS NOT NULL, b.rank) - 1 AS place
  FROM ranked b LEFT JOIN ranked t ON t.page = b.page AND t.id = b.attach_to AND t.attach_to IS NULL)"""


@query(f"WITH {s.BLOCKS}, {_ATTACHED}, {_PLACED} SELECT page, id, attach_to, rank, place FROM placed")
def attached_order(spark, sf):
    """O2, J10."""
    return order.place_attached(order.reading_order(_attached(spark, sf), half=500, row=8)).select("page", "id", "attach_to", "rank", "place")


@query(f"""WITH {s.BLOCKS}, {_ATTACHED}, {_PLACED} SELECT page, id, place AS "order", row_number() OVER (PARTITION BY page // 300 ORDER BY page, place) - 1 AS position_in_book FROM placed""")
def save_order(spark, sf):
    """O3: books of 300 pages."""
    return order.save_order(_attached(spark, sf).withColumn("book", F.expr("page div 300")), half=500, row=8).select("page", "id", "order", "position_in_book")


@query(f"WITH {s.BLOCKS} SELECT page, id, CAST(sum(CASE WHEN type = 'problem_number' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY ord) AS BIGINT) AS problem_index FROM blocks")
def problem_index(spark, sf):
    """W8."""
    return order.problem_index(s.blocks(spark, sf), "ord").select("page", "id", "problem_index")


@query(f"WITH {s.BLOCKS} SELECT page, max(CAST(regexp_extract('p' || page || '_b' || ord, '(\\d+)$', 1) AS BIGINT)) + 1 AS next_number FROM blocks WHERE ord % 7 <> 0 GROUP BY page")
def next_block_id(spark, sf):
    """A10, STR2."""
    b = s.blocks(spark, sf).filter("ord % 7 <> 0").withColumn("id", F.concat(F.lit("p"), "page", F.lit("_b"), "ord"))
    return order.next_numbers(b)


@query(f"""WITH {s.BLOCKS}, {_ATTACHED}, chosen AS (SELECT * FROM attached WHERE ord IN (3, 4)), rest AS (SELECT * FROM attached WHERE ord NOT IN (3, 4)),
made AS (SELECT c.page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, arg_max(type, [w * h, -ord]) AS type, min(ord) AS ord FROM chosen c GROUP BY page),
numbered AS (SELECT m.*, 'p' || m.page || '_bm' || lpad(CAST(n AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS id FROM made m JOIN
  (SELECT p.page, coalesce(max(CAST(regexp_extract(r.id, '(\\d+)$', 1) AS BIGINT)), -1) + 1 AS n FROM (SELECT DISTINCT page FROM chosen) p LEFT JOIN rest r USING (page) GROUP BY p.page) k USING (page))
SELECT r.page, r.id, r.ord, r.type, r.x, r.y, r.w, r.h, CASE WHEN c.id IS NOT NULL THEN n.id ELSE r.attach_to END AS attach_to
FROM rest r LEFT JOIN chosen c ON c.id = r.attach_to LEFT JOIN numbered n ON n.page = c.page
UNION ALL SELECT page, id, ord, type, x, y, w, h, NULL FROM numbered""")
def merge_union_box(spark, sf):
    """U3, A9, A10, J11, STR5: blocks 3 and 4 of each page become one."""
    b = _attached(spark, sf)
    return order.merge_blocks(b, b.filter("ord IN (3, 4)")).select("page", "id", "ord", "type", "x", "y", "w", "h", "attach_to")


@query(f"""WITH {s.BLOCKS}, {_ATTACHED}, gone AS (SELECT id FROM attached WHERE ord = 6)
SELECT a.page, a.id, a.type, CASE WHEN g.id IS NULL THEN a.attach_to END AS attach_to FROM attached a LEFT JOIN gone g ON g.id = a.attach_to WHERE ord <> 6""")
def delete_and_repoint(spark, sf):
    """U4, J11."""
    b = _attached(spark, sf)
    return order.delete_blocks(b, b.filter("ord = 6")).select("page", "id", "type", "attach_to")


@query(f"""WITH {s.BLOCKS}, {_ATTACHED}, linked AS (SELECT page, id, CASE WHEN ord = 9 AND type IN ('text', 'figure', 'formula', 'table') THEN 'p' || page || '_target' WHEN ord = 2 AND type IN ('text', 'figure', 'formula', 'table') THEN NULL ELSE attach_to END AS attach_to, ord, type FROM attached)
SELECT page, id, CASE WHEN ord = 12 THEN 'table' ELSE type END AS type, CASE WHEN ord = 12 THEN 'table' END AS role, CASE WHEN ord <> 12 THEN attach_to END AS attach_to FROM linked""")
def retype_and_attach(spark, sf):
    """U6, U8, P6, P19."""
    b = _attached(spark, sf)
    links = b.filter("ord IN (2, 9)").select("id", F.when(F.col("ord") == 9, F.concat(F.lit("p"), "page", F.lit("_target"))).alias("target"))
    linked = order.attach(b, links).withColumn("role", F.lit(None).cast("string"))
    return order.retype(linked, F.col("ord") == 12, F.lit("table")).select("page", "id", "type", "role", "attach_to")


@query(f"""WITH {s.BLOCKS}, r AS (SELECT *, CASE id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RB' ELSE '' END AS edges, x + 20 AS px0, y - 5 AS py0, x + CASE id % 2 WHEN 0 THEN 22 ELSE 400 END AS px1, y + CASE id % 5 WHEN 0 THEN -9 ELSE 60 END AS py1 FROM blocks WHERE ord IN (2, 5)),
q AS (SELECT page, id, CASE WHEN edges = 'L' THEN least(px0, px1 - 5) ELSE px0 END AS x0, py0 AS y0, px1, py1, edges FROM r),
n AS (SELECT page, id, x0, y0, CASE WHEN edges = 'RB' THEN greatest(px1, x0 + 5) ELSE px1 END AS x1, CASE WHEN edges = 'RB' THEN greatest(py1, y0 + 5) ELSE py1 END AS y1 FROM q)
SELECT b.page, b.id, coalesce(x0 / 1073, b.x) AS x, coalesce(y0 / 1500, b.y) AS y, coalesce((x1 - x0) / 1073, b.w) AS w, coalesce((y1 - y0) / 1500, b.h) AS h FROM blocks b LEFT JOIN n USING (page, id)""")
def resize_blocks(spark, sf):
    """Two blocks of each page drawn anew, some by dragging a side past the one across."""
    b = s.blocks(spark, sf)
    rects = b.filter("ord IN (2, 5)").selectExpr("page", "id", "CASE id % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RB' ELSE '' END AS edges", "x + 20 AS px0", "y - 5 AS py0", "x + CASE id % 2 WHEN 0 THEN 22 ELSE 400 END AS px1", "y + CASE id % 5 WHEN 0 THEN -9 ELSE 60 END AS py1")
    return order.resize(b.select("page", "id", *(F.col(c).cast("double").alias(c) for c in "xywh")), rects, F.lit(1073), F.lit(1500))


@query(f"""WITH {s.BLOCKS}, m AS (SELECT *, w * h AS area, CAST(median(w * h) OVER (PARTITION BY page, type) AS DOUBLE) AS median_area FROM blocks)
SELECT page, id, type, x, area > 2.5 * greatest(median_area, 1.0) AS needs_review FROM m""")
def discard_edits(spark, sf):
    """After edits and wrong flags, the saved blocks again."""
    saved = s.blocks(spark, sf).withColumn("needs_review", F.lit(True))
    return order.discard(saved, geom.area(geom.box()), least=1.0).select("page", "id", "type", "x", "needs_review")


@query(f"""WITH {s.BLOCKS}, {_ATTACHED}, drawn AS (SELECT page, x, y, w % 12 AS w, h % 9 AS h FROM blocks WHERE ord IN (1, 8)),
ok AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, w, h) - 1 AS i FROM drawn WHERE w > 5 AND h > 5),
n AS (SELECT page, max(CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) + 1 AS n, max(ord) AS o FROM attached GROUP BY page)
SELECT page, id, ord, type, x, y, w, h FROM attached UNION ALL
SELECT page, 'p' || page || '_bn' || lpad(CAST(n + i AS VARCHAR), CAST(greatest(2, length(CAST(n + i AS VARCHAR))) AS INTEGER), '0'), o + 1 + i, 'text', x, y, w, h FROM ok JOIN n USING (page)""")
def insert_drawn(spark, sf):
    """U5, P20, A10."""
    drawn = s.blocks(spark, sf).filter("ord IN (1, 8)").selectExpr("page", "x", "y", "w % 12 AS w", "h % 9 AS h")
    return order.insert_drawn(_attached(spark, sf), drawn).select("page", "id", "ord", "type", "x", "y", "w", "h")


@query(f"""WITH {s.BLOCKS} SELECT page, id, x FROM blocks WHERE page % 3 <> 0 UNION ALL SELECT page, id, x + 1 FROM blocks WHERE page % 3 = 0 AND ord < 9""")
def page_replace(spark, sf):
    """U9."""
    b = s.blocks(spark, sf).select("page", "id", "x", "ord")
    return order.replace_pages(b, b.filter("page % 3 = 0 AND ord < 9").withColumn("x", F.col("x") + 1)).select("page", "id", "x")


@query(f"""WITH {s.BLOCKS}, o AS (SELECT page, list({_ID.format('id')} ORDER BY ord DESC) || ['none'] AS ids FROM blocks WHERE ord % 4 = 1 GROUP BY page)
SELECT o.page, pos, b.id FROM (SELECT page, unnest(ids) AS tid, generate_subscripts(ids, 1) - 1 AS pos FROM o) o JOIN (SELECT *, {_ID.format('id')} AS tid FROM blocks) b ON b.tid = o.tid""")
def block_order_lookup(spark, sf):
    """J8."""
    b = s.blocks(spark, sf)
    tid = tx.block_id(F.col("page"), F.col("id"))
    pages = b.filter("ord % 4 = 1").groupBy("page").agg(F.reverse(F.transform(F.array_sort(F.collect_list(F.struct("ord", tid.alias("i")))), lambda q: q["i"])).alias("o")).select("page", F.array_append("o", F.lit("none")).alias("block_order"))
    named = b.select(tid.alias("id"), "ord", F.col("id").alias("number"))
    return order.in_block_order(pages, named).select("page", "pos", F.col("number").alias("id"))


# Diff -------------------------------------------------------------------------------------------------


@query(f"WITH {s.BLOCKS}, p AS (SELECT a.page, a.id AS a_id, e.id AS e_id, {_iou('a', 'e')} AS iou FROM blocks a JOIN blocks e ON a.page = e.page AND a.id < e.id) SELECT page, a_id, e_id, round(iou, 9) AS iou FROM p WHERE iou > 0.0")
def iou_pairs(spark, sf):
    """J1."""
    b = s.blocks(spark, sf)
    return diff.pairs(b, b, 0.0, strict=True).filter("a_id < e_id").select("page", "a_id", "e_id", F.round("iou", 9).alias("iou"))


@query(f"""WITH {s.BLOCKS} SELECT a.page, a.id FROM blocks a WHERE a.type = 'problem_number' AND NOT EXISTS (SELECT 1 FROM blocks e WHERE e.page = a.page AND e.type <> 'problem_number' AND {_iou('a', 'e')} > 0.05)""")
def badge_dedupe(spark, sf):
    """J4 (over 0.05, as few overlap)."""
    b = s.blocks(spark, sf)
    return diff.without_overlap(b.filter("type = 'problem_number'"), b.filter("type <> 'problem_number'"), 0.05).select("page", "id")


_BEST = f"""met AS (SELECT a.page, a.id AS a_id, a.type AS a_type, e.id AS e_id, e.type AS e_type, e.ord AS e_ord, {_iou('a', 'e')} AS iou FROM blocks a JOIN edited e ON a.page = e.page),
best AS (SELECT *, iou >= 0.3 AS position_ok, iou >= 0.3 AND a_type = e_type AS type_ok FROM (SELECT *, row_number() OVER (PARTITION BY page, a_id ORDER BY iou DESC, e_ord) AS r FROM met) WHERE r = 1)"""


@query(f"WITH {s.BLOCKS}, {s.EDITED}, {_BEST} SELECT page, a_id, e_id, round(iou, 9) AS iou, position_ok, type_ok FROM best")
def best_match(spark, sf):
    """J5."""
    return diff.best_match(s.blocks(spark, sf), s.edited(spark, sf)).withColumn("iou", F.round("iou", 9))


@query(f"""WITH {s.BLOCKS}, {s.EDITED}, {_BEST} SELECT count(*) AS n, count(*) FILTER (position_ok) AS position_hits, count(*) FILTER (type_ok) AS type_hits,
count(*) FILTER (position_ok) / count(*) AS coverage, count(*) FILTER (type_ok) / greatest(count(*) FILTER (position_ok), 1) AS type_accuracy FROM best""")
def match_accuracy(spark, sf):
    """A6."""
    return diff.accuracy(diff.best_match(s.blocks(spark, sf), s.edited(spark, sf)))


@query(f"WITH RECURSIVE {s.CROWDED}, {_greedy('crowd_a', 'crowd_e')} SELECT page, a_id, e_id, round(iou, 9) AS iou FROM matches")
def greedy_match(spark, sf):
    """J2, where boxes compete."""
    return diff.greedy_match(*s.crowded(spark, sf)).withColumn("iou", F.round("iou", 9))


def _matched(spark, sf):
    a, e = s.blocks(spark, sf), s.edited(spark, sf)
    return a, e, diff.greedy_match(a, e)


_MATCHED = f"WITH RECURSIVE {s.BLOCKS}, {s.EDITED}, {_greedy('blocks', 'edited')}"


@query(f"""{_MATCHED} SELECT 'deleted' AS change, page, id, type FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page = b.page AND m.a_id = b.id)
UNION ALL SELECT 'added', page, id, type FROM edited b WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page = b.page AND m.e_id = b.id)""")
def deleted_added(spark, sf):
    """J3."""
    a, e, m = _matched(spark, sf)
    gone = diff.unmatched(a, m, "a_id").select(F.lit("deleted").alias("change"), "page", "id", "type")
    return gone.unionByName(diff.unmatched(e, m, "e_id").select(F.lit("added").alias("change"), "page", "id", "type"))


@query(f"{_MATCHED} SELECT a.type AS a_type, e.type AS e_type, count(*) AS n FROM matches m JOIN blocks a ON a.id = m.a_id JOIN edited e ON e.id = m.e_id WHERE a.type <> e.type GROUP BY ALL")
def type_change_pairs(spark, sf):
    """A5."""
    a, e, m = _matched(spark, sf)
    return diff.type_changes(m, a, e)


@query(f"""{_MATCHED} SELECT m.page, m.a_id, m.e_id FROM matches m JOIN blocks a ON a.id = m.a_id JOIN edited e ON e.id = m.e_id
WHERE a.type = e.type AND (abs(a.x - e.x) > 10 OR abs(a.y - e.y) > 10 OR abs(a.w - e.w) > 10 OR abs(a.h - e.h) > 10)""")
def resized_pairs(spark, sf):
    """P10."""
    a, e, m = _matched(spark, sf)
    return diff.resized(m, a, e, 10)


@query(f"""{_MATCHED}, gone AS (SELECT *, CASE WHEN x > 650 THEN 'sidebar' ELSE 'body' END AS region FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page = b.page AND m.a_id = b.id)),
g AS (SELECT type, region, count(*) AS n, min(page * 100 + ord) AS first, list(page ORDER BY page, ord)[1:6] AS pages FROM gone GROUP BY ALL)
SELECT type, region, n, array_to_string(pages, ',') AS pages, row_number() OVER (ORDER BY n DESC, first) AS place FROM g""")
def diff_report(spark, sf):
    """Of deleted blocks."""
    a, _, m = _matched(spark, sf)
    return diff.report(diff.unmatched(a, m, "a_id"), 650).withColumn("pages", F.array_join("pages", ","))


# Page lookups -----------------------------------------------------------------------------------------


@query(f"WITH {_UNITS} SELECT p.page, unit, start_page, end_page, coalesce(unit, 'I-1') AS viewer_unit FROM (SELECT DISTINCT 1 + event_id // 16 AS page FROM events) p LEFT JOIN units u ON p.page BETWEEN start_page AND end_page")
def unit_range_join(spark, sf):
    """J6."""
    pages = s.blocks(spark, sf).select("page").distinct()
    return answers.unit_of(pages, answers.units(spark)).withColumn("viewer_unit", F.coalesce("unit", F.lit("I-1")))


@query(f"WITH {_UNITS} SELECT c_custkey AS reader, coalesce(unit, 'I-1') AS unit, CASE WHEN unit IS NULL THEN 10 ELSE page END AS open_page FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 400 END AS page FROM customer) c LEFT JOIN units ON page BETWEEN start_page AND end_page")
def start_page(spark, sf):
    """J14."""
    saved = s.table(spark, sf, "customer").selectExpr("c_custkey AS reader", "CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 400 END AS page")
    return answers.start_page(saved, answers.units(spark)).select("reader", "unit", "open_page")


@query(f"""WITH {_UNITS}, p AS (SELECT unit, unnest(generate_series(start_page, end_page)) AS page FROM units), st AS (SELECT 1 + event_id // 16 AS page, max(event_id % 3) = 2 AND (1 + event_id // 16) % 4 <> 0 AS done FROM events GROUP BY 1 + event_id // 16)
SELECT unit, count(*) FILTER (coalesce(done, FALSE)) AS done, count(*) FILTER (NOT coalesce(done, FALSE)) AS pending FROM p LEFT JOIN st USING (page) GROUP BY unit""")
def unit_progress(spark, sf):
    """A12, G1, E12, P8."""
    st = s.blocks(spark, sf).groupBy("page").agg(F.max(F.col("id") % 3).alias("m")).select("page", F.when((F.col("m") == 2) & (F.col("page") % 4 != 0), "done").otherwise("pending").alias("status"))
    return answers.unit_progress(answers.units(spark), st)


@query(f"WITH {s.ANCHORS} SELECT book, answer_page, a, b FROM kept")
def monotone_anchors(spark, sf):
    """W6, STR3's ranges."""
    return islands.monotone(s.anchors(spark, sf), ["book"], "answer_page", "a")


_MAP = f"""{s.ANCHORS}, covered AS (SELECT book, k, min(answer_page) AS v FROM (SELECT book, answer_page, unnest(generate_series(a, b)) AS k FROM kept) GROUP BY book, k),
known AS (SELECT * FROM covered WHERE k % 3 <> 0),
domain AS (SELECT book, unnest(generate_series(10, 291)) AS page FROM (SELECT DISTINCT book FROM known)),
near AS (SELECT book, page, (SELECT max(k) FROM known WHERE k <= page AND known.book = domain.book) AS k0, (SELECT min(k) FROM known WHERE k >= page AND known.book = domain.book) AS k1 FROM domain),
valued AS (SELECT near.book, page, k0, k1, CAST(a.v AS DOUBLE) AS v0, CAST(b.v AS DOUBLE) AS v1 FROM near LEFT JOIN known a ON a.k = k0 AND a.book = near.book LEFT JOIN known b ON b.k = k1 AND b.book = near.book),
mapped AS (SELECT book, page, greatest(1, least(900, CAST(CASE WHEN k0 = k1 THEN v0 WHEN k0 IS NULL THEN v1 WHEN k1 IS NULL THEN v0 ELSE round_even(v0 + (page - k0) / (k1 - k0) * (v1 - v0), 0) END AS BIGINT))) AS answer_page FROM valued)"""


def _mapped(spark, sf):
    kept = islands.monotone(s.anchors(spark, sf), ["book"], "answer_page", "a")
    return answers.interpolated(answers.first_answers(kept, ("book",)).filter("k % 3 <> 0"), 900, keys=("book",))


@query(f"WITH {_MAP} SELECT book, page, answer_page FROM mapped")
def answer_page_map(spark, sf):
    """A11, W7, P18 (with every third page left out, so that there is something to fill)."""
    return _mapped(spark, sf)


@query(f"""WITH {_MAP}, known_map AS (SELECT * FROM mapped WHERE page % 2 = 0)
SELECT p.book, p.page, coalesce(e.answer_page, c.answer_page) AS answer_page FROM (SELECT book, unnest(generate_series(1, 400)) AS page FROM (SELECT DISTINCT book FROM raw)) p
LEFT JOIN known_map e ON e.page = p.page AND e.book = p.book LEFT JOIN known_map c ON c.page = greatest(10, least(290, p.page)) AND c.book = p.book""")
def answer_lookup(spark, sf):
    """J9."""
    asked = s.anchors(spark, sf).select("book").distinct().select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(400).cast("long"))).alias("page"))
    return answers.answer_for(asked, _mapped(spark, sf).filter("page % 2 = 0"), ("book",))


@query(f"""WITH {_MAP} SELECT book, '{{"schema_version":"1.0","count":900,"page_w":1240,"page_h":1754,"page_map":{{' || string_agg('"' || page || '":' || answer_page, ',' ORDER BY page) || '}}}}' AS document FROM mapped GROUP BY book""")
def answers_documents(spark, sf):
    """Each book's answers.json."""
    return answers.answers_document(_mapped(spark, sf), ("book",), 900, 1240, 1754)


# State ------------------------------------------------------------------------------------------------


def _state(spark, sf):
    return state.latest(state.accepted(s.ledger(spark, sf)))


@query(f"WITH {s.LEDGER} SELECT book, kind, key, v, t, d, seq FROM latest")
def lww_state(spark, sf):
    """ST1, ST3, A13, P15, ST9: tombstones included."""
    return _state(spark, sf)


@query(f"WITH {s.LEDGER} SELECT book, kind, key, v, t FROM latest WHERE d = 0")
def lww_live(spark, sf):
    """P17, ST8."""
    return state.live(_state(spark, sf)).select("book", "kind", "key", "v", "t")


@query(f"""WITH {s.LEDGER}, old AS (SELECT * FROM entries WHERE kind <> 'unknown' AND seq % 2 = 0), was AS (SELECT book, kind, key, max(t) AS t FROM old GROUP BY ALL),
every AS (SELECT book, kind, key, v, d, t, seq, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS late FROM entries WHERE kind <> 'unknown'),
now AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book, kind, key ORDER BY t DESC, late, seq) AS r FROM every) WHERE r = 1)
SELECT book, kind, key, CASE WHEN d = 0 THEN v END AS v, now.t, d, seq, coalesce(now.t > was.t, TRUE) AS changed FROM now LEFT JOIN was USING (book, kind, key)""")
def lww_merge(spark, sf):
    """ST2, ST4, U10: a request merged into the stored state."""
    e = state.accepted(s.ledger(spark, sf))
    before = state.latest(e.filter("seq % 2 = 0"))
    after = state.merged(before, e.filter("seq % 2 = 1"))
    new = state.changed(before, after).withColumn("changed", F.lit(True))
    return after.join(new, state.KEY, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


@query(f"WITH {s.LEDGER} SELECT book, key, v, rank FROM (SELECT book, key, v, row_number() OVER (PARTITION BY book ORDER BY coalesce(TRY_CAST(v AS DOUBLE), 0) DESC, CAST(key AS BIGINT)) AS rank FROM latest WHERE kind = 'recent' AND d = 0) WHERE rank <= 20")
def recent_top20(spark, sf):
    """O4."""
    return state.recent(_state(spark, sf)).select("book", "key", "v", "rank")


@query(f"WITH {s.LEDGER} SELECT book, key, v, row_number() OVER (PARTITION BY book ORDER BY CAST(json_extract_string(v, '$.at') AS DOUBLE) DESC, CAST(key AS BIGINT)) AS rank FROM latest WHERE kind = 'bookmarks' AND d = 0")
def bookmarks_desc(spark, sf):
    """O5."""
    return state.bookmarks(_state(spark, sf)).select("book", "key", "v", "rank")


@query(f"WITH {s.LEDGER} SELECT book, key, row_number() OVER (PARTITION BY book ORDER BY CAST(key AS BIGINT)) AS rank FROM latest WHERE kind = 'favorites' AND d = 0")
def favorites_asc(spark, sf):
    """O5."""
    return state.favourites(_state(spark, sf)).select("book", "key", "rank")


@query(f"""WITH {s.LEDGER}, asked AS (SELECT DISTINCT 'book' || (user_id % 10) AS book, CAST(user_id AS VARCHAR) AS key FROM events)
SELECT a.book, a.key, CASE WHEN l.key IS NULL THEN 'true' END AS favorite, CAST(CASE WHEN l.key IS NULL THEN 0 ELSE 1 END AS BIGINT) AS favorite_gone, b.key IS NULL AS bookmark_added
FROM asked a LEFT JOIN latest l ON l.book = a.book AND l.key = a.key AND l.kind = 'favorites' AND l.d = 0 LEFT JOIN latest b ON b.book = a.book AND b.key = a.key AND b.kind = 'bookmarks' AND b.d = 0""")
def ledger_mutators(spark, sf):
    """ST11, ST3."""
    st = _state(spark, sf)
    asked = s.table(spark, sf, "events").select(F.format_string("book%d", F.col("user_id") % 10).alias("book"), F.col("user_id").cast("string").alias("key")).distinct()
    now = F.lit(1.0)
    fav = state.toggled(st, asked.withColumn("kind", F.lit("favorites")), now).select("book", "key", F.col("v").alias("favorite"), F.col("d").alias("favorite_gone"))
    new = state.added(st, asked.withColumn("kind", F.lit("bookmarks")), now).select("book", "key", F.lit(True).alias("bookmark_added"))
    return fav.join(new, ["book", "key"], "left").withColumn("bookmark_added", F.coalesce("bookmark_added", F.lit(False)))


@query(f"""WITH {s.LEDGER}, every AS (SELECT book, kind, key, v, d, t, seq, seq % 2 AS late FROM entries WHERE kind <> 'unknown'),
l AS (SELECT *, row_number() OVER (PARTITION BY book, kind, key ORDER BY t DESC, late, seq) AS r FROM every), m AS (SELECT *, row_number() OVER (PARTITION BY book, kind, key ORDER BY t DESC, 1 - late, seq) AS r FROM every)
SELECT 'local' AS side, book, kind, key, CASE WHEN d = 0 THEN v END AS v, t, d FROM l WHERE r = 1 UNION ALL SELECT 'server', book, kind, key, CASE WHEN d = 0 THEN v END, t, d FROM m WHERE r = 1""")
def reconcile(spark, sf):
    """ST6: a device's state (even entries) and the server's (odd ones) after a pull and a push."""
    e = state.accepted(s.ledger(spark, sf))
    local, server = state.reconciled(state.latest(e.filter("seq % 2 = 0")), state.latest(e.filter("seq % 2 = 1")))
    columns = ["book", "kind", "key", "v", "t", "d"]
    return local.select(F.lit("local").alias("side"), *columns).unionByName(server.select(F.lit("server").alias("side"), *columns))


@query("""WITH e AS (SELECT DISTINCT 'book' || (user_id % 10) AS book, epoch_us(ts) / 1000 AS t FROM events), n AS (SELECT *, lead(t) OVER (PARTITION BY book ORDER BY t) AS later FROM e)
SELECT book, t + 600000 AS at FROM n WHERE later IS NULL OR later - t >= 600000""")
def debounced_pushes(spark, sf):
    """ST5, with a wait of ten minutes, as the events are minutes apart."""
    e = s.table(spark, sf, "events").select(F.format_string("book%d", F.col("user_id") % 10).alias("book"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"))
    return state.pushes(e, 600_000)


@query(f"WITH {s.LEDGER} SELECT book, kind, key, v, t, d FROM latest WHERE book <> 'book3'")
def ledger_read(spark, sf):
    """Each book's state written as one text, with a kind that is not known and one book's text cut off, and read again."""
    st = _state(spark, sf)
    other = st.limit(0).unionByName(st.select("book", F.lit("spam").alias("kind"), F.lit("k").alias("key"), F.lit("1").alias("v"), F.lit(1.0).alias("t"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("seq")).distinct())
    text = state.to_payload(st.unionByName(other)).withColumn("state", F.when(F.col("book") == "book3", F.expr("left(state, 40)")).otherwise(F.col("state")))
    return text.select("book", F.explode(state.from_ledger(F.col("state"))).alias("e")).select("book", "e.*")


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'done' WHEN 2 THEN 'important' END AS mark FROM events)
SELECT event_id, mark, CASE WHEN mark IS NULL THEN 'done' WHEN mark = 'done' THEN 'important' END AS next_mark, (event_id // 16) || ':' || (event_id % 16) AS key FROM m""")
def mark_cycle(spark, sf):
    """ML1, STR7."""
    m = s.table(spark, sf, "events").selectExpr("event_id", "CASE event_id % 4 WHEN 1 THEN 'done' WHEN 2 THEN 'important' END AS mark")
    return m.select("event_id", "mark", tx.next_mark(F.col("mark")).alias("next_mark"), tx.mark_key(F.expr("event_id div 16"), F.col("event_id") % 16).alias("key"))


# Classification ---------------------------------------------------------------------------------------


@query(f"""WITH {s.REPLIES}, b AS (SELECT id, raw, regexp_extract(raw, '\\{{.*\\}}', 0, 's') AS body FROM replies),
j AS (SELECT id, raw, CASE WHEN body <> '' AND json_valid(body) THEN json_extract_string(body, '$.type') END AS k, CASE WHEN body <> '' AND json_valid(body) THEN TRY_CAST(json_extract_string(body, '$.confidence') AS DOUBLE) END AS c FROM b),
f AS (SELECT *, coalesce(k IN ({", ".join(f"'{t}'" for t in tx.TYPES)}) AND c IS NOT NULL, FALSE) AS fine FROM j)
SELECT id, CASE WHEN fine THEN k ELSE 'text' END AS type, CASE WHEN fine THEN c ELSE 0.0 END AS confidence, NOT fine OR c < 0.6 AS needs_review FROM f""")
def parse_responses(spark, sf):
    """STR1."""
    return s.replies(spark, sf).select("id", tx.parse_reply(F.col("raw")).alias("p")).select("id", "p.*")


@query(f"""WITH {s.BLOCKS}, r AS (SELECT page, id, CASE WHEN type = 'problem_number' AND w > 80 THEN 'text' WHEN type <> 'problem_number' AND id % 9 = 0 THEN 'problem_number' ELSE type END AS type FROM blocks)
SELECT page, id, type, CASE type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.ROLES.items())} ELSE 'paragraph' END AS role FROM r""")
def type_rules(spark, sf):
    """P7, P6."""
    return classify.final_types(s.blocks(spark, sf).withColumn("number_coloured", F.col("id") % 9 == 0), 80).select("page", "id", "type", "role")


_CACHE = "h AS (SELECT doc_id, sha256(text) AS image_hash FROM documents WHERE text IS NOT NULL), cache AS (SELECT DISTINCT image_hash, 'text' AS type FROM h WHERE doc_id % 3 = 0)"


def _crops(spark, sf):
    return classify.with_hash(s.table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("image")))


def _cache(spark, sf):
    return _crops(spark, sf).filter("doc_id % 3 = 0").select("image_hash", F.lit("text").alias("type"), F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review")).distinct()


@query(f"WITH {_CACHE} SELECT doc_id, h.image_hash, type, type IS NOT NULL AS hit FROM h LEFT JOIN cache USING (image_hash)")
def cache_hits(spark, sf):
    """J7, H1, R13."""
    return classify.cache_lookup(_crops(spark, sf), _cache(spark, sf)).select("doc_id", "image_hash", "type", "hit")


@query(f"WITH {_CACHE} SELECT DISTINCT image_hash, CASE WHEN cache.image_hash IS NULL THEN 'figure' ELSE 'text' END AS type, CAST(CASE WHEN cache.image_hash IS NULL THEN 0.75 ELSE 0.9 END AS DOUBLE) AS confidence FROM h LEFT JOIN cache USING (image_hash)".replace("DISTINCT image_hash", "DISTINCT h.image_hash"))
def classify_misses(spark, sf):
    """J7, S7, F1 with a stub backend: contents that the cache lacks are classified once and added."""
    crops, cache = _crops(spark, sf), _cache(spark, sf)
    new = classify.classify(classify.misses(crops, cache), lambda: lambda data: 'so: {"type": "figure", "confidence": "0.75"}')
    return classify.refreshed(cache, new).select("image_hash", "type", "confidence")


# Segmentation -----------------------------------------------------------------------------------------

_BANDS = f"{s.GRID}, bands AS (SELECT page, min(y) AS p0, max(y) + 1 AS p1 FROM (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM (SELECT page, y FROM grid GROUP BY page, y HAVING sum(x1 - x0) > 2)) GROUP BY page, g)"


def _bands(spark, sf):
    return islands.row_bands(s.text_grid(spark, sf), ["page"])


@query(f"WITH {_BANDS} SELECT page, p0, p1 FROM bands")
def bands(spark, sf):
    """W1, A7."""
    return _bands(spark, sf)


@query(f"""WITH {_BANDS}, g AS (SELECT *, CASE WHEN p0 - lag(p1) OVER (PARTITION BY page ORDER BY p0) <= 15 THEN 0 ELSE 1 END AS fresh FROM bands),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY p0) AS island FROM g) SELECT page, min(p0) AS p0, max(p1) AS p1, count(*) AS n FROM i GROUP BY page, island""")
def band_groups(spark, sf):
    """W3."""
    return islands.merge_gaps(_bands(spark, sf), ["page"], F.lit(15), inclusive=True)


@query(f"WITH {_BANDS}, m AS (SELECT page, CAST(median(p1 - p0) AS DOUBLE) AS median_h FROM bands GROUP BY page) SELECT page, median_h, greatest(6, CAST(trunc(median_h * 0.9) AS BIGINT)) AS gap FROM m")
def line_height(spark, sf):
    """A8."""
    return islands.line_height(_bands(spark, sf), ["page"])


_COLUMNS = """dens AS (SELECT page, x, count(*) + k AS d FROM (SELECT 1 + event_id // 16 AS page, event_id % 400 + 40 * (event_id % 16) AS x, event_id % 3 AS k FROM events) GROUP BY page, x, k), cruns AS (
  SELECT page, min(x) AS p0, max(x) + 1 AS p1 FROM (SELECT page, x, x - row_number() OVER (PARTITION BY page ORDER BY x) AS g FROM dens WHERE d >= 2) GROUP BY page, g)"""


@query(f"""WITH {_COLUMNS}, g AS (SELECT *, CASE WHEN p0 - lag(p1) OVER (PARTITION BY page ORDER BY p0) < 90 THEN 0 ELSE 1 END AS fresh FROM cruns),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY p0) AS island FROM g) SELECT page, min(p0) AS p0, max(p1) AS p1, count(*) AS n FROM i GROUP BY page, island""")
def columns_merge(spark, sf):
    """A height of 100, so the least density is 2."""
    d = s.table(spark, sf, "events").groupBy(F.expr("1 + event_id div 16").alias("page"), F.expr("event_id % 400 + 40 * (event_id % 16)").alias("x"), F.expr("event_id % 3").alias("k")).agg(F.count("*").alias("c")).select("page", F.col("x").alias("p0"), (F.col("x") + 1).alias("p1"), (F.col("c") + F.col("k")).alias("d"))
    d = d.groupBy("page", "p0", "p1").agg(F.max("d").alias("d"))
    return islands.column_runs(d, ["page"], F.lit(100), 90)


@query(f"""WITH {s.BLOCKS}, m AS (SELECT page, ord AS i, h, list(h) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks)
SELECT page, min(i) AS split_at FROM m WHERE before IS NOT NULL AND h > 1.35 * greatest(CAST(list_median(before) AS DOUBLE), 1.0) GROUP BY page""")
def tall_split(spark, sf):
    """W5, U2."""
    return islands.first_tall(s.blocks(spark, sf).withColumn("i", F.col("ord")), ["page"])


def _comps(spark, sf):
    b = s.blocks(spark, sf).filter("type = 'text' AND w > 5")
    return b.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("x0"), F.lit(20).cast("long").alias("w"), "h"))).alias("comps"))


_COMPS = "c AS (SELECT page, x AS x0, CAST(20 AS BIGINT) AS w, h FROM blocks WHERE type = 'text' AND w > 5), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x0, w, h) AS i, lead(x0) OVER (PARTITION BY page ORDER BY x0, w, h) - (x0 + w) AS gap FROM c)"


@query(f"WITH {s.BLOCKS}, {_COMPS} SELECT page, x0, w, h, gap FROM o")
def component_gaps(spark, sf):
    """W4, O6."""
    b = s.blocks(spark, sf).filter("type = 'text' AND w > 5").select("page", F.col("x").alias("x0"), F.lit(20).cast("long").alias("w"), "h")
    return islands.gap_vector(b, ["page"])


@query(f"""WITH {s.BLOCKS}, {_COMPS}, g AS (SELECT page, count(*) AS n, max(gap) FILTER (i = 1) AS g1, CAST(median(gap) FILTER (i > 1 AND gap IS NOT NULL) AS DOUBLE) AS mid FROM o GROUP BY page)
SELECT page, coalesce(n >= 3 AND g1 >= 15 AND g1 >= 2.2 * greatest(mid, 1.0), FALSE) AS has_label FROM g""")
def label_split(spark, sf):
    """R10."""
    return _comps(spark, sf).select("page", islands.label_split(F.col("comps")).alias("has_label"))


@query(f"""WITH {s.BLOCKS}, {_COMPS}, e AS (SELECT page, count(*) AS n, min(x0) AS l, arg_max(x0 + w, i) AS r FROM o GROUP BY page),
gaps AS (SELECT o.page, arg_min((x0 + w + x0 + w + gap) // 2, [abs((x0 + w + x0 + w + gap) / 2 - (l + r) / 2), i]) AS cut FROM o JOIN e USING (page) WHERE gap >= 4 GROUP BY o.page)
SELECT page, CASE WHEN n < 2 THEN 'none' WHEN (r - l) / 1000 < 0.5 THEN 'tight' WHEN cut IS NOT NULL THEN 'split' ELSE 'none' END AS kind,
  CASE WHEN n < 2 THEN NULL WHEN (r - l) / 1000 < 0.5 THEN l ELSE cut END AS a, CASE WHEN n >= 2 AND (r - l) / 1000 < 0.5 THEN r END AS b FROM e LEFT JOIN gaps USING (page)""")
def wrap_long_lines(spark, sf):
    """R9, O7, U2."""
    return _comps(spark, sf).select("page", islands.wrap_at(F.col("comps"), F.lit(1000)).alias("r")).select("page", "r.*")


@query(f"""WITH {s.BLOCKS} SELECT page, id, greatest(0, x - 3) AS x0, greatest(0, y - 3) AS y0, least(1000, x + w + 3) AS x1, least(1000, y + h + 3) AS y1 FROM blocks
WHERE NOT (w < 7 OR h < 7 OR w * h < 400 OR (x / 1000 > 0.90 AND (y + h) / 1000 < 0.35))""")
def debris_and_pad(spark, sf):
    """P3, P2."""
    b = s.blocks(spark, sf)
    x, y, w, h = geom.box()
    side = F.lit(1000).cast("long")
    kept = b.filter(~islands.debris(x, y, x + w, y + h, side, side))
    return kept.select("page", "id", geom.padded(x, y, x + w, y + h, side, side).alias("p")).select("page", "id", "p.*")


_JUNK = "(x1 - x0 < 7 OR y1 - y0 < 7 OR (x1 - x0) * (y1 - y0) < 400 OR (x0 / width > 0.90 AND y1 / height < 0.35))"
# The stages of R7 as tables. In the grid all rows of a line have the same runs, so a run of a line is a component.
_DETECT = f"""{s.GRID},
ends AS (SELECT page, p, sum(s) AS s FROM (SELECT page, x0 AS p, 1 AS s FROM grid UNION ALL SELECT page, x1, -1 FROM grid) GROUP BY page, p),
dens AS (SELECT page, p AS p0, lead(p) OVER w AS p1, sum(s) OVER w AS d FROM ends WINDOW w AS (PARTITION BY page ORDER BY p)),
cfresh AS (SELECT page, p0, p1, CASE WHEN p0 - lag(p1) OVER (PARTITION BY page ORDER BY p0) < 20 THEN 0 ELSE 1 END AS fresh FROM dens JOIN size USING (page) WHERE d > 0 AND d >= greatest(2, height * 0.004e0)),
cols AS (SELECT page, min(p0) AS c0, max(p1) AS c1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY p0) AS island FROM cfresh) GROUP BY page, island),
cut AS (SELECT g.page, c0, y, greatest(x0, c0) AS x0, least(x1, c1) AS x1, tint FROM grid g JOIN cols c ON c.page = g.page AND x0 < c1 AND x1 > c0),
crows AS (SELECT page, c0, y FROM cut GROUP BY page, c0, y HAVING sum(x1 - x0) > 2),
cbands AS (SELECT page, c0, min(y) AS p0, max(y) + 1 AS p1 FROM (SELECT *, y - row_number() OVER (PARTITION BY page, c0 ORDER BY y) AS g FROM crows) GROUP BY page, c0, g),
joining AS (SELECT page, greatest(6, CAST(trunc(median(p1 - p0) * 0.9e0) AS BIGINT)) AS gap FROM cbands GROUP BY page),
bfresh AS (SELECT page, c0, p0, p1, CASE WHEN p0 - lag(p1) OVER (PARTITION BY page, c0 ORDER BY p0) <= CASE WHEN c0 / width > 0.65 THEN CAST(trunc(gap * 2.2e0) AS BIGINT) ELSE gap END THEN 0 ELSE 1 END AS fresh
  FROM cbands JOIN joining USING (page) JOIN size USING (page) WHERE p1 - p0 >= 3),
blk AS (SELECT page, c0, min(p0) AS p0, max(p1) AS p1 FROM (SELECT *, sum(fresh) OVER (PARTITION BY page, c0 ORDER BY p0) AS island FROM bfresh) GROUP BY page, c0, island),
brows AS (SELECT k.*, p0, p1 FROM cut k JOIN blk b ON b.page = k.page AND b.c0 = k.c0 AND y >= p0 AND y < p1),
tightened AS (SELECT page, c0, p0, min(x0) AS x0, p0 AS y0, max(x1) AS x1, p1 AS y1 FROM brows GROUP BY page, c0, p0, p1),
box AS (SELECT t.*, b.p1 AS l1 FROM tightened t JOIN size USING (page) JOIN cbands b ON b.page = t.page AND b.c0 = t.c0 AND b.p0 = t.p0 WHERE NOT {_JUNK}),
comp AS (SELECT r.page, r.c0, r.p0, r.x0, r.x1 - r.x0 AS w, count(*) AS h, (r.x1 - r.x0) * count(*) AS area, sum(tint) AS tint FROM brows r JOIN box b ON b.page = r.page AND b.c0 = r.c0 AND b.p0 = r.p0 AND r.y < b.l1 GROUP BY r.page, r.c0, r.p0, r.x0, r.x1 HAVING count(*) >= 10),
placed AS (SELECT *, row_number() OVER w AS i, lead(x0) OVER w - (x0 + w) AS gap FROM comp WINDOW w AS (PARTITION BY page, c0, p0 ORDER BY x0, w, h)),
heads AS (SELECT page, c0, p0, count(*) AS n, max(x0) FILTER (i = 1) AS fx, max(w) FILTER (i = 1) AS fw, max(x0) FILTER (i = 2) AS sx, max(area) FILTER (i = 1) AS fa, max(tint) FILTER (i = 1) AS ft,
  max(gap) FILTER (i = 1) AS g1, CAST(median(gap) FILTER (i > 1 AND gap IS NOT NULL) AS DOUBLE) AS mid FROM placed GROUP BY page, c0, p0),
judged AS (SELECT b.*, fx, fw, sx, coalesce(n >= 2 AND fa >= 20 AND ft > 0.6e0 * fa, FALSE) AS coloured, coalesce(n >= 3 AND g1 >= 15 AND g1 >= 2.2e0 * greatest(mid, 1.0), FALSE) AS spaced FROM box b LEFT JOIN heads USING (page, c0, p0)),
piece AS (SELECT page, c0, p0, 0 AS piece, CASE WHEN coloured THEN fx ELSE x0 END AS x0, y0, fx + fw AS x1, l1 AS y1 FROM judged WHERE coloured OR spaced
  UNION ALL SELECT page, c0, p0, 1, CASE WHEN coloured OR spaced THEN sx ELSE x0 END, y0, x1, y1 FROM judged),
prows AS (SELECT p.page, p.c0, p.p0, p.piece, r.y, greatest(r.x0, p.x0) AS x0, least(r.x1, p.x1) AS x1 FROM brows r JOIN piece p ON p.page = r.page AND p.c0 = r.c0 AND p.p0 = r.p0 AND r.y >= p.y0 AND r.y < p.y1 AND r.x0 < p.x1 AND r.x1 > p.x0),
pink AS (SELECT page, c0, p0, piece, y FROM prows GROUP BY page, c0, p0, piece, y HAVING sum(x1 - x0) > 2),
pbands AS (SELECT page, c0, p0, piece, min(y) AS b0, max(y) + 1 - min(y) AS h FROM (SELECT *, y - row_number() OVER (PARTITION BY page, c0, p0, piece ORDER BY y) AS g FROM pink) GROUP BY page, c0, p0, piece, g),
ahead AS (SELECT *, list(h) OVER (PARTITION BY page, c0, p0, piece ORDER BY b0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pbands),
split AS (SELECT page, c0, p0, piece, min(b0) AS cut_y FROM ahead WHERE before IS NOT NULL AND h > 1.35e0 * greatest(CAST(list_median(before) AS DOUBLE), 1.0) GROUP BY page, c0, p0, piece),
sides AS (SELECT page, c0, p0, piece, y >= cut_y AS low, min(x0) AS tx0, max(x1) AS tx1 FROM prows JOIN split USING (page, c0, p0, piece) GROUP BY page, c0, p0, piece, y >= cut_y),
halves AS (SELECT page, c0, p0, piece, NULL AS low, x0, y0, x1, y1 FROM piece ANTI JOIN split USING (page, c0, p0, piece)
  UNION ALL SELECT page, c0, p0, piece, FALSE, x0, y0, x1, cut_y FROM piece JOIN split USING (page, c0, p0, piece) UNION ALL SELECT page, c0, p0, piece, TRUE, x0, cut_y, x1, y1 FROM piece JOIN split USING (page, c0, p0, piece)),
fine AS (SELECT page, coalesce(tx0, x0) AS x0, y0, coalesce(tx1, x1) AS x1, y1 FROM halves LEFT JOIN sides USING (page, c0, p0, piece, low)),
found AS (SELECT page, greatest(0, x0 - 3) AS x0, greatest(0, y0 - 3) AS y0, least(width, x1 + 3) AS x1, least(height, y1 + 3) AS y1 FROM fine JOIN size USING (page) WHERE NOT {_JUNK})"""


def _detected(spark, sf):
    return islands.text_blocks(s.text_grid(spark, sf), s.page_sizes(spark, sf), ["page"])


@query(f"WITH {_DETECT} SELECT page, x0, y0, x1, y1 FROM found")
def detect_blocks(spark, sf):
    """R7, R5, R6, R10, R11, U2, W5, P3, P5, P11 on the lines of all texts."""
    return _detected(spark, sf)


_LINES = f"""{_DETECT}, lrows AS (SELECT b.page, b.x0 AS left_x, b.y0 AS top_y, y, greatest(g.x0, b.x0) AS x0, least(g.x1, b.x1) AS x1 FROM grid g JOIN found b ON b.page = g.page AND y >= b.y0 AND y < b.y1 AND g.x0 < b.x1 AND g.x1 > b.x0),
link AS (SELECT page, left_x, top_y, y FROM lrows GROUP BY ALL HAVING sum(x1 - x0) > 2), lbands AS (SELECT page, left_x, top_y, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY page, left_x, top_y ORDER BY y) AS g FROM link) GROUP BY page, left_x, top_y, g HAVING count(*) >= 3),
lines AS (SELECT b.page, b.left_x, b.top_y, min(x0) AS x0, y0, max(x1) AS x1, y1 FROM lbands b JOIN lrows r ON r.page = b.page AND r.left_x = b.left_x AND r.top_y = b.top_y AND r.y >= y0 AND r.y < y1 GROUP BY b.page, b.left_x, b.top_y, y0, y1)"""


def _lines(spark, sf):
    boxes = _detected(spark, sf).withColumns({"left_x": F.col("x0"), "top_y": F.col("y0")})
    return islands.lines_in_boxes(s.text_grid(spark, sf), boxes, ["page"], ["left_x", "top_y"])


@query(f"WITH {_LINES} SELECT page, left_x, top_y, x0, y0, x1, y1 FROM lines")
def box_lines(spark, sf):
    """Lines of the blocks that R7 finds."""
    return _lines(spark, sf).select("page", "left_x", "top_y", "x0", "y0", "x1", "y1")


@query(f"""WITH {_LINES}, wide AS (SELECT l.*, (l.x1 - l.x0) / width > 332 / 1073 AS long FROM lines l JOIN size USING (page)),
word AS (SELECT DISTINCT l.page, l.left_x, l.top_y, l.y0, r.x0 - l.x0 AS x, r.x1 - r.x0 AS w FROM wide l JOIN lrows r ON r.page = l.page AND r.left_x = l.left_x AND r.top_y = l.top_y AND r.y >= l.y0 AND r.y < l.y1 WHERE long AND r.x1 - r.x0 >= 3),
wgap AS (SELECT *, row_number() OVER v AS i, lead(x) OVER v AS nx FROM word WINDOW v AS (PARTITION BY page, left_x, top_y, y0 ORDER BY x, w)),
span AS (SELECT page, left_x, top_y, y0, count(*) AS n, min(x) AS l, arg_max(x + w, i) AS r FROM wgap GROUP BY ALL),
mid AS (SELECT page, left_x, top_y, y0, arg_min((x + w + nx) // 2, [abs((x + w + nx) / 2 - (l + r) / 2), i]) AS cut_x FROM wgap JOIN span USING (page, left_x, top_y, y0) WHERE nx - (x + w) >= 4 GROUP BY ALL),
judge AS (SELECT d.*, CASE WHEN n >= 2 AND (r - l) / (d.x1 - d.x0) < 0.5 THEN 'tight' WHEN n >= 2 AND cut_x IS NOT NULL THEN 'split' ELSE 'none' END AS kind, l, r, cut_x FROM wide d LEFT JOIN span USING (page, left_x, top_y, y0) LEFT JOIN mid USING (page, left_x, top_y, y0))
SELECT page, left_x, top_y, CAST(0 AS BIGINT) AS half, CASE kind WHEN 'tight' THEN x0 + l ELSE x0 END AS x0, y0, CASE kind WHEN 'tight' THEN x0 + r WHEN 'split' THEN x0 + cut_x ELSE x1 END AS x1, y1 FROM judge
UNION ALL SELECT page, left_x, top_y, 1, x0 + cut_x, y0, x1, y1 FROM judge WHERE kind = 'split'""")
def wrap_lines(spark, sf):
    """Lines wider than the reader's column in two halves, one tightened box, or as they are."""
    lines = _lines(spark, sf).join(s.page_sizes(spark, sf), "page").withColumn("line_y", F.col("y0"))
    long = (F.col("x1") - F.col("x0")) / F.col("width") > layout.WRAP_WIDTH
    return islands.wrapped_lines(s.text_grid(spark, sf), lines, ["page"], ["left_x", "top_y", "line_y"], long).select("page", "left_x", "top_y", "half", "x0", "y0", "x1", "y1")


@query(f"""WITH {s.RASTER}, n AS (SELECT id, level, count(*) AS n FROM pixels GROUP BY ALL),
c AS (SELECT id, level, CAST(sum(n) OVER u AS BIGINT) AS b, CAST(sum(n * level) OVER u AS BIGINT) AS t, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS an, CAST(sum(n * level) OVER (PARTITION BY id) AS BIGINT) AS at_ FROM n WINDOW u AS (PARTITION BY id ORDER BY level)),
sc AS (SELECT id, level, CASE WHEN an > b THEN b * (an - b) * pow(t / b - (at_ - t) / (an - b), 2) ELSE 0 END AS score FROM c)
SELECT id, level AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, level) AS r FROM sc) WHERE r = 1""")
def otsu_hist(spark, sf):
    """R1's level."""
    return raster.otsu_levels(s.raster(spark, sf), ["id"])


def _dark_sql(pixels: str, pre: str = "") -> str:
    """Tables up to {pre}dark: the pixels (id, p, x, y, level) at most as light as Otsu's level."""
    return f"""{pre}n AS (SELECT id, level, count(*) AS n FROM {pixels} GROUP BY ALL),
{pre}c AS (SELECT id, level, CAST(sum(n) OVER u AS BIGINT) AS b, CAST(sum(n * level) OVER u AS BIGINT) AS t, CAST(sum(n) OVER (PARTITION BY id) AS BIGINT) AS an, CAST(sum(n * level) OVER (PARTITION BY id) AS BIGINT) AS at_ FROM {pre}n WINDOW u AS (PARTITION BY id ORDER BY level)),
{pre}otsu AS (SELECT id, arg_max(level, [score, -level]) AS threshold FROM (SELECT id, level, CASE WHEN an > b THEN b * (an - b) * pow(t / b - (at_ - t) / (an - b), 2) ELSE 0 END AS score FROM {pre}c) GROUP BY id),
{pre}dark AS (SELECT {pixels}.* FROM {pixels} JOIN {pre}otsu USING (id) WHERE level <= threshold)"""


def _parts_sql(mask: str, pre: str = "") -> str:
    """Tables up to {pre}part: label and area of the part that each of the mask's pixels is in."""
    return f"""{pre}reach AS (SELECT id, p AS a, p AS z, x, y FROM {mask} UNION SELECT r.id, r.a, d.p, d.x, d.y FROM {pre}reach r JOIN {mask} d ON d.id = r.id AND abs(d.x - r.x) <= 1 AND abs(d.y - r.y) <= 1),
{pre}part AS (SELECT id, a AS p, min(z) AS label, count(*) AS area FROM {pre}reach GROUP BY id, a)"""


_INK = f"""{s.PICTURES}, {_dark_sql("px")}, {_parts_sql("dark")}, ink AS (SELECT px.*, coalesce(area >= 4, FALSE) AS on_, label FROM px LEFT JOIN part USING (id, p))"""


def _closed_sql(name: str, width: int, height: int, ellipse: str = "TRUE", mask: str = "ink") -> str:
    """Tables of a mask grown and shrunk again: {name}_c (id, p, on_)."""
    near = f"abs(q.x - m.x) <= {width // 2} AND abs(q.y - m.y) <= {height // 2} AND {ellipse}"
    return f"""{name}_g AS (SELECT m.id, m.p, m.x, m.y, bool_or(q.on_) AS on_ FROM {mask} m JOIN {mask} q ON q.id = m.id AND {near} GROUP BY ALL),
{name}_c AS (SELECT m.id, m.p, bool_and(q.on_) AS on_ FROM {name}_g m JOIN {name}_g q ON q.id = m.id AND {near} GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_INK} SELECT id, string_agg(CASE WHEN on_ THEN '1' ELSE '0' END, '' ORDER BY p) AS mask FROM ink GROUP BY id")
def ink_masks(spark, sf):
    """R1, P4."""
    return raster.ink_masks(s.pictures(spark, sf))


_KERNELS = {"lines": raster.rectangle(9, 3), "words": raster.rectangle(5, 3), "round": raster.ellipse(5, 5)}


@query(f"""WITH RECURSIVE {_INK}, {_closed_sql("l", 9, 3)}, {_closed_sql("w", 5, 3)}, {_closed_sql("e", 5, 5, "(abs(q.y - m.y) < 2 OR q.x = m.x)")}
SELECT l_c.id, string_agg(CASE WHEN l_c.on_ THEN '1' ELSE '0' END, '' ORDER BY p) AS lines, string_agg(CASE WHEN w_c.on_ THEN '1' ELSE '0' END, '' ORDER BY p) AS words, string_agg(CASE WHEN e_c.on_ THEN '1' ELSE '0' END, '' ORDER BY p) AS round
FROM l_c JOIN w_c USING (id, p) JOIN e_c USING (id, p) GROUP BY l_c.id""")
def closed_masks(spark, sf):
    """R2: closed by 9 by 3, 5 by 3, and an ellipse (5 by 5, as the pictures are small)."""
    return raster.closed_masks(s.pictures(spark, sf), _KERNELS)


@query(f"""WITH RECURSIVE {_INK} SELECT id, string_agg(CASE WHEN on_ AND NOT (x >= id % 5 - 1 AND x < id % 5 + 2 AND y >= id % 3 AND y < id % 3 + 4) AND NOT (x >= 6 AND x < 20 AND y >= 5 AND y < 6) THEN '1' ELSE '0' END, '' ORDER BY p) AS mask FROM ink GROUP BY id""")
def blanked_masks(spark, sf):
    """Without two boxes, which may reach over the side."""
    boxes = "array(struct(id % 5 - 1 AS x0, id % 3 AS y0, id % 5 + 2 AS x1, id % 3 + 4 AS y1), struct(6L AS x0, 5L AS y0, 20L AS x1, 6L AS y1))"
    return raster.blanked_masks(s.pictures(spark, sf).withColumn("boxes", F.expr(boxes)))


@query(f"WITH RECURSIVE {_INK} SELECT id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM ink WHERE on_ GROUP BY id, label")
def ink_parts(spark, sf):
    """R5."""
    return raster.ink_parts(s.pictures(spark, sf))


_HSV = f"""{s.COLOURS}, v AS (SELECT *, greatest(blue, green, red) AS v, least(blue, green, red) AS low, (blue * 1868 + green * 9617 + red * 4899 + 8192) // 16384 AS grey FROM colours),
h AS (SELECT *, CASE WHEN v = low THEN 0.0e0 WHEN v = red THEN 60 * (green - blue) / (v - low) WHEN v = green THEN 120 + 60 * (blue - red) / (v - low) ELSE 240 + 60 * (red - green) / (v - low) END AS deg FROM v),
hsv AS (SELECT *, round_even(CASE WHEN deg < 0 THEN deg + 360 ELSE deg END / 2, 0) AS hue, CASE WHEN v > 0 THEN round_even(255 * (v - low) / v, 0) ELSE 0 END AS sat FROM h)"""


@query(f"""WITH {_HSV}, s AS (SELECT id, count(*) FILTER (grey < 180) AS ink, count(*) FILTER (grey < 180 AND hue BETWEEN 85 AND 172 AND sat BETWEEN 5 AND 255 AND v BETWEEN 60 AND 250) AS hit FROM hsv GROUP BY id)
SELECT id, ink, CASE WHEN ink > 0 THEN hit / ink ELSE 0.0 END AS share, ink >= 20 AND CASE WHEN ink > 0 THEN hit / ink ELSE 0.0 END > 0.6 AS coloured FROM s""")
def colour_shares(spark, sf):
    """Over wider ranges of hue and saturation, as the pictures have few strong colours."""
    return raster.colour_shares(s.colour_pixels(spark, sf), ["id"], {"hue": (85, 172), "saturation": (5, 255), "value": (60, 250)})


_BADGES = f"""{_HSV}, tint AS (SELECT id, p, x, y, hue BETWEEN 85 AND 125 AND sat BETWEEN 60 AND 255 AND v BETWEEN 40 AND 250 AS on_ FROM hsv), {_closed_sql("t", 3, 3, "(q.x = m.x OR q.y = m.y)", "tint")},
shade AS (SELECT id, p, p % 8 AS x, p // 8 AS y FROM t_c WHERE on_), {_parts_sql("shade", "s_")},
box AS (SELECT id, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM shade JOIN s_part USING (id, p) GROUP BY id, label),
badge AS (SELECT * FROM box WHERE area BETWEEN 2 AND 40 AND y1 - y0 BETWEEN 2 AND 8 AND x1 - x0 <= 6 AND NOT (x0 / 8 > 0.80 AND y0 / 8 < 0.20)),
greys AS (SELECT id, p, x, y, grey AS level FROM v), {_dark_sql("greys", "g_")}, {_parts_sql("g_dark", "g_")},
number AS (SELECT DISTINCT b.id, b.label, d.x - b.x1 AS c FROM badge b JOIN g_dark d ON d.id = b.id AND d.y >= b.y0 AND d.y < b.y1 AND d.x - b.x1 BETWEEN 1 AND 3 JOIN g_part g ON g.id = d.id AND g.p = d.p WHERE g.area >= 4),
gapped AS (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY id, label ORDER BY c) - 1 > 1 THEN 1 ELSE 0 END AS fresh FROM number),
ends AS (SELECT id, label, max(c) + 1 AS reach FROM (SELECT *, sum(fresh) OVER (PARTITION BY id, label ORDER BY c) AS island FROM gapped) WHERE island = 0 GROUP BY id, label)"""


@query(f"WITH RECURSIVE {_BADGES} SELECT id, x0, y0, x1 + coalesce(reach, 0) AS x1, y1 FROM badge LEFT JOIN ends USING (id, label)")
def icon_badges(spark, sf):
    """With small limits, as the pictures are small."""
    return raster.picture_badges(s.colour_pictures(spark, sf), kernel=raster.ellipse(3, 3), reach=(1, 4, 1), areas=(2, 40), heights=(2, 8), widest=6)


@query("""WITH c AS (SELECT vec_id AS id, vec_id % 4 AS x0, vec_id % 3 AS y0 FROM embeddings WHERE len(embedding) = 64), t AS (SELECT id, list(CAST(floor((greatest(-0.5, least(0.5, CAST(embedding[1 + 8 * (y0 + k // 3) + x0 + k % 3] AS DOUBLE))) + 0.5) * 255) AS BIGINT) ORDER BY k) AS v
  FROM (SELECT vec_id AS id, embedding, vec_id % 4 AS x0, vec_id % 3 AS y0, unnest(generate_series(0, 5)) AS k FROM embeddings WHERE len(embedding) = 64) GROUP BY id)
SELECT id, sha256(from_hex(list_aggregate(list_transform(v, lambda q: lpad(to_hex(q), 2, '0')), 'string_agg', ''))) AS image_hash FROM t""")
def crop_hashes(spark, sf):
    """Hashes of crops of three by two pixels (their bytes; no encoder is here)."""
    boxes = "struct(cast(id % 4 as int) AS x0, cast(id % 3 as int) AS y0, cast(id % 4 + 3 as int) AS x1, cast(id % 3 + 2 as int) AS y1)"
    return classify.with_hash(raster.crops(s.pictures(spark, sf).withColumn("box", F.expr(boxes)))).select("id", "image_hash")


# Layout -----------------------------------------------------------------------------------------------

_ROLE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.ROLES.items()) + " END"


@query(f"""WITH {s.BLOCKS}, b AS (SELECT page, id, {_ROLE} AS role, x / 1000 AS x, y / 1000 AS y, w / 1000 AS w, h / 1000 AS h, id % 4 = 1 AS split FROM blocks),
m AS (SELECT *, role IN ('label', 'page_number') AS auto, role IN ('paragraph', 'equation') AND split AS by_lines FROM b),
z AS (SELECT *, least(CASE role WHEN 'label' THEN 26 / (h * 1500) WHEN 'page_number' THEN 22 / (h * 1500) ELSE 332 / (CASE WHEN by_lines THEN w * 0.75 ELSE w END * 1073) END, CASE WHEN role = 'paragraph' THEN 3.2 ELSE 2.0 END) AS scale FROM m)
SELECT page, id, role, round(scale, 9) AS scale, round(w * 1073 * scale, 6) AS draw_w, round(0 - x * 1073 * scale, 6) AS offset_x, NOT auto AND NOT by_lines AND w * (1073 * scale) < 332 - 1e-6 AS centred FROM z""")
def layout_scale(spark, sf):
    """M3, M4, A14, J13."""
    b = s.blocks(spark, sf).select("page", "id", tx.role_of(F.col("type")).alias("role"), *((F.col(c) / 1000).alias(c) for c in "xywh"))
    line = lambda k: F.struct(F.col("x"), F.col("y"), (F.col("w") * k).alias("w"), F.col("h"))
    b = b.withColumn("lines", F.when(F.col("id") % 4 == 1, F.array(line(0.5), line(0.75)))).withColumn("page_w", F.lit(1073)).withColumn("page_h", F.lit(1500))
    d = layout.scaled(b, 332)
    # Within a millionth of the container's width counts as filling it, as either engine may round the last bit.
    centred = F.col("centred") & (F.col("draw_w") < 332 - 1e-6)
    return d.select("page", "id", "role", F.round("scale", 9).alias("scale"), F.round("draw_w", 6).alias("draw_w"), F.round("offset_x", 6).alias("offset_x"), centred.alias("centred"))


@query("""WITH p AS (SELECT p_partkey AS page, CASE WHEN p_partkey % 7 = 0 THEN 0.4 + (p_partkey % 5) / 100 WHEN p_partkey % 2 = 1 THEN 0.462 ELSE 0.49 END AS g FROM part),
c AS (SELECT page, 0 AS i, 0.05 AS x0, g AS x1 FROM p UNION ALL SELECT page, 1, g, 0.98 FROM p)
SELECT page, CAST(i AS BIGINT) AS i, round(x0, 9) AS x0, round(x1, 9) AS x1, round(360 / (x1 - x0), 6) AS full_w, round(360 / (x1 - x0) * 1.4, 6) AS full_h, round(-x0 * 360 / (x1 - x0), 6) AS offset_x FROM c""")
def answer_columns(spark, sf):
    """M5."""
    p = s.table(spark, sf, "part").select(F.col("p_partkey").alias("page"))
    own = p.filter("page % 7 = 0").select("page", (0.4 + (F.col("page") % 5) / 100).alias("split"))
    d = layout.answer_columns(p, own, 360, 1.4)
    return d.select("page", "i", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"), *(F.round(c, 6).alias(c) for c in ("full_w", "full_h", "offset_x")))


@query(f"WITH {s.BLOCKS} SELECT page, id, w / 1000 > 332 / 1073 * 0.5 AND type IN ('text', 'formula') AND id % 3 <= 1 AS wrap FROM blocks".replace("332 / 1073 * 0.5", "332 / 1073"))
def wrap_candidates(spark, sf):
    """P14."""
    return s.blocks(spark, sf).select("page", "id", layout.to_wrap(F.col("type"), F.col("w") / 1000, F.col("id") % 3).alias("wrap"))


# Documents --------------------------------------------------------------------------------------------

_B = '{"id": "b", "page": 1, "type": "text", "bbox": [0, 0, 1, 1]'
_PAGES = '{"schema_version": "1.0", "book_id": "k", "pages": '
_BLOCKS = '{"schema_version": "1.0", "book_id": "k", "blocks": '
_BOOK = '{"schema_version": "1.0", "id": "b-1", "title": "T", "page_count": 3, "created_at": "2024-01-01T00:00:00Z"'
# Documents of each kind, in which {n} is a number from -2 to 4, and in SQL what is wrong with them.
_CASES = [
    ("block", _B + "}", "''"),
    ("block", '{"id": "b", "page": {n}, "type": "text", "bbox": [0.1, 0.2, 0.3, 0.4], "order": {n}}', "CASE WHEN n < 0 THEN 'page,order' WHEN n < 1 THEN 'page' ELSE '' END"),
    ("block", '{"id": "b", "page": "x", "type": "text", "bbox": [0, 0, 1, 1], "order": "y"}', "'type of page,type of order'"),
    ("block", '{"id": "b", "page": 1.5, "type": "text", "bbox": [0, 0, 1, 1]}', "'type of page'"),
    ("block", '{"id": "b", "page": 2.0, "type": "text", "bbox": [0, 0, 1, 1]}', "''"),
    ("block", '{"id": 7, "page": true, "type": "text", "bbox": [0, 0, 1, 1]}', "'type of id,type of page'"),
    ("block", '{"id": "b", "page": 1, "type": "poem", "bbox": [0.1, 0.2, 0.3]}', "'type,bbox size'"),
    ("block", '{"id": "b", "page": 1, "type": "text", "bbox": [0.1, 0.2, 0.3, 1.4], "extra": 1, "a": 2}', "'unknown a,unknown extra,bbox range'"),
    ("block", '{"page": 1, "type": "text", "bbox": [null, 0, 1, "1", 0]}', "'missing id,bbox size,bbox range'"),
    ("block", "[1]", "'not an object'"),
    ("block", _B + ', "text": null}', "'null text'"),
    ("block", _B + ', "confidence": 1.5, "order": -1}', "'order,confidence'"),
    ("block", _B + ', "reflow": {"role": "x"}}', "'reflow role'"),
    ("block", _B + ', "reflow": {"role": "label", "align": "middle", "full_width": "yes", "zoom": 1}}', "'reflow unknown zoom,reflow type of full_width,reflow align'"),
    ("block", _B + ', "lines": [{"bad": 1}]}', "'lines[0] missing bbox,lines[0] unknown bad'"),
    ("block", _B + ', "lines": [{"bbox": [0, 0, 1, 1]}, {"bbox": [0, 0, {n}, 1], "text": 5}]}', "CASE WHEN n BETWEEN 0 AND 1 THEN '' ELSE 'lines[1] bbox range,' END || 'lines[1] type of text'"),
    ("block", _B + ', "lines": 5, "latex": [], "reflow": "r"}', "'type of reflow,type of lines,type of latex'"),
    ("block", '{"id": "b"', "'not an object'"),
    ("block", _B + "} and more", "'not an object'"),
    ("block", "", "'not an object'"),
    ("blocks", '{"schema_version": "1", "book_id": "k", "blocks": []}', "'schema_version'"),
    ("blocks", _BLOCKS + "[" + _B + '}, {"id": "c", "page": {n}, "type": "poem", "bbox": [0, 0, 1, 1]}, 7]}', "CASE WHEN n < 1 THEN 'blocks[1] page,' ELSE '' END || 'blocks[1] type,blocks[2] not an object'"),
    ("blocks", _BLOCKS + "{}}", "'type of blocks'"),
    ("pages", _PAGES + '[{"nonsense": 1}]}', "'pages[0] missing number,pages[0] missing width_px,pages[0] missing height_px,pages[0] unknown nonsense'"),
    ("pages", _PAGES + '[{"number": {n}, "width_px": 0, "height_px": 5, "rotation": 45}]}', "CASE WHEN n < 1 THEN 'pages[0] number,' ELSE '' END || 'pages[0] width_px,pages[0] rotation'"),
    ("pages", _PAGES + '[{"number": 1, "width_px": 2, "height_px": 5, "rotation": 90, "deskew_angle": "1", "source_crop": [0, 1], "block_order": ["a", 1], "problems": [{"label": "x"}]}]}',
     "'pages[0] type of deskew_angle,pages[0] source_crop size,pages[0] type of block_order[1],pages[0] problems[0] missing id'"),
    ("pages", '{"book_id": "k"}', "'missing schema_version,missing pages'"),
    ("book", _BOOK + ', "tags": ["a"], "rendering": {"dpi": 150, "image_format": "png"}, "chapters": [{"id": "c", "title": "t", "start_page": 1, "level": 0}]}', "''"),
    ("book", '{"schema_version": "1.0", "id": "Bad_Id", "title": "", "page_count": {n}, "cover_page": {n}, "created_at": 5}', "'id,title' || CASE WHEN n < 0 THEN ',page_count' ELSE '' END || CASE WHEN n < 1 THEN ',cover_page' ELSE '' END || ',type of created_at'"),
    ("book", _BOOK + ', "rendering": {"dpi": 0, "image_format": "gif", "x": 1}, "chapters": [{"id": "c", "title": "t", "order": -1}], "tags": ["a", 2]}',
     "'rendering unknown x,rendering dpi,rendering image_format,chapters[0] missing start_page,chapters[0] order,type of tags[1]'"),
]


def _case_sql(what: int) -> str:
    return f"CASE id % {len(_CASES)} " + " ".join(f"WHEN {i} THEN " + (f"'{c[0]}'" if what == 0 else c[2]) for i, c in enumerate(_CASES)) + " END"


@query(f"WITH {s.BLOCKS} SELECT id, {_case_sql(0)} AS kind, {_case_sql(2)} AS violations FROM (SELECT id, id % 7 - 2 AS n FROM blocks)")
def schema_violations(spark, sf):
    """V1: documents that break each rule of each kind."""
    place = F.col("id") % len(_CASES)
    text = F.element_at(F.array(*(F.lit(c[1]) for c in _CASES)), (place + 1).cast("int"))
    docs_ = s.blocks(spark, sf).select("id", place.alias("i"), F.replace(text, F.lit("{n}"), (F.col("id") % 7 - 2).cast("string")).alias("j"))
    found = None
    for kind in dict.fromkeys(c[0] for c in _CASES):
        own = docs_.filter(F.col("i").isin([i for i, c in enumerate(_CASES) if c[0] == kind]))
        own = own.select("id", F.lit(kind).alias("kind"), F.array_join(docs.violations(F.col("j"), kind), ",").alias("violations"))
        found = own if found is None else found.unionByName(own)
    return found


@query(f"WITH {s.BLOCKS} SELECT id, CASE WHEN id % 5 IN (0, 1) OR id % 3 = 0 THEN NULL ELSE page END AS last_page FROM blocks")
def last_page_roundtrip(spark, sf):
    """Pages to documents and back; some have no document, a bad one, or one without a page."""
    text = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.lit("{page")).otherwise(docs.last_page_text(F.when(F.col("id") % 3 != 0, F.col("page"))))
    return s.blocks(spark, sf).select("id", docs.last_page(text.cast("string")).alias("last_page"))


@query(f"""WITH {s.BLOCKS} SELECT page, max(w) AS widest, bool_or(x > 700) AS any_right, bool_or(w <> h) AS any_unlike, list_aggregate(list(id ORDER BY ord)[1:3], 'string_agg', ',') AS first_ids, list_aggregate(flatten(list([x, x + w] ORDER BY ord)), 'string_agg', ',') AS ends FROM blocks GROUP BY page""")
def array_functions(spark, sf):
    """AR1: greatest, any, compared in pairs, a slice, nested lists in one."""
    b = s.blocks(spark, sf).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("ord", "id", "x", "w", "h"))).alias("b"))
    of = lambda name: F.transform("b", lambda r: r[name])
    unlike = F.exists(F.zip_with(of("w"), of("h"), lambda w, h: w != h), lambda v: v)
    ends = F.flatten(F.transform("b", lambda r: F.array(r["x"], r["x"] + r["w"])))
    return b.select("page", F.array_max(of("w")).alias("widest"), F.exists(of("x"), lambda x: x > 700).alias("any_right"), unlike.alias("any_unlike"), F.array_join(F.slice(of("id"), 1, 3), ",").alias("first_ids"), F.array_join(ends, ",").alias("ends"))


@query("SELECT event_id, CAST(round_even(event_id / 4 - 50, 0) AS BIGINT) AS even, CAST(floor(event_id / 4 - 50 + 0.5) AS BIGINT) AS up, CAST(trunc(event_id / 4 - 50) AS BIGINT) AS cut FROM events")
def rounding(spark, sf):
    """M1: quarters, so that halves are met, below and above 0."""
    v = F.col("event_id") / 4 - 50
    return s.table(spark, sf, "events").select("event_id", geom.half_even(v).alias("even"), geom.half_up(v).alias("up"), geom.truncated(v).alias("cut"))


@query(f"WITH {s.BLOCKS} SELECT page, ord AS key, CASE WHEN id % 3 = 0 THEN 'done' ELSE 'pending' END AS value FROM blocks")
def json_map_roundtrip(spark, sf):
    """S5, S7, MP1: rows to a JSON object a page and back."""
    b = s.blocks(spark, sf).select("page", F.struct(F.col("ord").cast("int").alias("key"), F.when(F.col("id") % 3 == 0, "done").otherwise("pending").alias("value")).alias("e"))
    text = b.groupBy("page").agg(docs.map_text(F.array_sort(F.collect_list("e"))).alias("j"))
    return text.select("page", F.explode(docs.map_rows(F.col("j"))).alias("e")).select("page", "e.key", "e.value")


@query(f"""WITH {s.BLOCKS}, f AS (SELECT page, CASE id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' ELSE 'webp' END AS ending FROM blocks WHERE id % 37 < 3)
SELECT p.page, (SELECT arg_min(ending, CASE ending WHEN 'webp' THEN 0 WHEN 'png' THEN 1 ELSE 2 END) FROM f WHERE f.page = p.page AND ending <> 'gif') AS ending FROM (SELECT DISTINCT page FROM blocks) p""")
def image_fallback(spark, sf):
    """S12."""
    b = s.blocks(spark, sf)
    files = b.filter("id % 37 < 3").selectExpr("page", "CASE id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' ELSE 'webp' END AS ending")
    return docs.first_image(b.select("page").distinct(), files)


@query("""SELECT event_id, lpad(CAST(event_id // 16 AS VARCHAR), CAST(greatest(4, length(CAST(event_id // 16 AS VARCHAR))) AS INTEGER), '0') || '.webp' AS file, '/book/' || 'b' || '/page/' || (event_id // 16) AS url,
CASE WHEN event_id // 60 > 0 THEN (event_id // 60) || '분 ' || (event_id % 60) || '초' ELSE (event_id % 60) || '초' END AS eta, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, base64(encode(event_type)) AS b64 FROM events""")
def text_functions(spark, sf):
    """STR5, STR8, DT1, DT2, B1."""
    page = F.expr("event_id div 16")
    return s.table(spark, sf, "events").select("event_id", tx.page_file(page).alias("file"), tx.image_url(F.lit("b"), page).alias("url"), tx.duration_text(F.col("event_id").cast("double")).alias("eta"), tx.iso_utc(F.col("ts")).alias("at"), F.base64(F.col("event_type").cast("binary")).alias("b64"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'p. ' || (event_id % 400) || ' ~ ' || (event_id % 400 + event_id % 20) WHEN 1 THEN (event_id % 300) || '-' || (event_id % 300 + 3) || ' x' WHEN 2 THEN 'none' ELSE '9-5' END AS raw FROM events),
r AS (SELECT event_id, TRY_CAST(regexp_extract(raw, '(\\d{1,3})\\s*[~-]\\s*(\\d{1,3})', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(raw, '(\\d{1,3})\\s*[~-]\\s*(\\d{1,3})', 2) AS BIGINT) AS b FROM t)
SELECT event_id, CASE WHEN a <= b AND b - a <= 15 AND a BETWEEN 10 AND 295 THEN a END AS a, CASE WHEN a <= b AND b - a <= 15 AND a BETWEEN 10 AND 295 THEN b END AS b FROM r""")
def header_spans(spark, sf):
    """STR3, S14's texts."""
    raw = "CASE event_id % 4 WHEN 0 THEN concat('p. ', event_id % 400, ' ~ ', event_id % 400 + event_id % 20) WHEN 1 THEN concat(event_id % 300, '-', event_id % 300 + 3, ' x') WHEN 2 THEN 'none' ELSE '9-5' END AS raw"
    return s.table(spark, sf, "events").selectExpr("event_id", raw).select("event_id", tx.page_span(F.col("raw")).alias("r")).select("event_id", "r.a", "r.b")


@query(f"""WITH {s.BLOCKS}, n AS (SELECT page, count(*) AS n FROM blocks WHERE type <> 'problem_number' GROUP BY page), badge AS (SELECT page, x, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS i FROM blocks WHERE type = 'problem_number')
SELECT page, ord, type, x, CAST(0.9 AS DOUBLE) AS confidence, FALSE AS needs_review FROM blocks WHERE type <> 'problem_number' UNION ALL SELECT page, coalesce(n, 0) + i, 'problem_number', x, 0.6, TRUE FROM badge LEFT JOIN n USING (page)""")
def append_badges(spark, sf):
    """U1."""
    b = s.blocks(spark, sf)
    own = b.filter("type <> 'problem_number'").select("page", tx.block_id(F.col("page"), F.col("ord")).alias("id"), "ord", "type", "x", "y", "w", "h", F.lit(0.9).alias("confidence"), F.lit(False).alias("needs_review"))
    return order.append_badges(own, b.filter("type = 'problem_number'")).select("page", "ord", "type", "x", "confidence", "needs_review")

