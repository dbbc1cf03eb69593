"""Stand-ins for scanned pages, derived from the driver's tables by whole-number arithmetic, in Spark and in SQL.

Boxes are in thousandths of the page, so areas and overlaps are whole numbers in both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TYPE = "CASE WHEN event_id % 16 = 15 THEN 'page_number' WHEN event_type = 'view' THEN 'text' WHEN event_type = 'click' THEN 'problem_number' WHEN event_type = 'purchase' THEN 'figure' WHEN event_type = 'signup' THEN 'formula' ELSE 'table' END"


def _block_columns(div: str) -> str:
    return f"""1 + event_id {div} 16 AS page, event_id AS id, event_id % 16 AS ord, {_TYPE} AS type,
    (event_id * 7919) % 800 AS x, (event_id * 104729) % 900 AS y,
    20 + CASE WHEN event_type = 'click' THEN (event_id * 31) % 90 ELSE (event_id * 6007) % 180 END AS w, 10 + (event_id * 3571) % 90 AS h"""


BLOCKS = f"blocks AS (SELECT {_block_columns('//')} FROM events)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 blocks a page from events: page, id, ord, type, x, y, w, h."""
    return table(spark, sf_dir, "events").selectExpr(*_split(_block_columns("div")))


def _split(columns: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


_EDITED = """page, id, ord, CASE WHEN id % 13 = 0 THEN CASE WHEN type = 'formula' THEN 'text' ELSE 'formula' END ELSE type END AS type,
    x + CASE WHEN id % 7 = 0 THEN 3 WHEN id % 19 = 0 THEN 20 ELSE 0 END AS x, y, w, h"""
_ADDED = "page, id + 100000000 AS id, ord + 100 AS ord, 'text' AS type, (x + 400) % 800 AS x, (y + 450) % 900 AS y, w, h"
EDITED = f"edited AS (SELECT {_EDITED} FROM blocks WHERE id % 11 <> 0 UNION ALL SELECT {_ADDED} FROM blocks WHERE id % 17 = 0)"


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 after corrections: blocks dropped, retyped, shifted and added."""
    b = blocks(spark, sf_dir)
    return b.filter("id % 11 <> 0").selectExpr(*_split(_EDITED)).unionByName(b.filter("id % 17 = 0").selectExpr(*_split(_ADDED)))


def _crowded(div: str, a: int) -> str:
    return f"1 + event_id {div} 8 AS page, event_id AS id, event_id % 8 AS ord, 'text' AS type, (event_id * {7919 + a}) % 30 AS x, (event_id * {104729 + a}) % 29 AS y, 40 + (event_id * {31 + a}) % 20 AS w, 40 + (event_id * {53 + a}) % 19 AS h"


CROWDED = f"crowd_a AS (SELECT {_crowded('//', 0)} FROM events), crowd_e AS (SELECT {_crowded('//', 12)} FROM events)"


def crowded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Eight automatic and eight edited boxes a page that all overlap, so that they compete."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(*_split(_crowded("div", 0))), e.selectExpr(*_split(_crowded("div", 12)))


_LEDGER = """user_id % 10 AS book_no, CASE event_type WHEN 'view' THEN 'marks' WHEN 'click' THEN 'favorites' WHEN 'purchase' THEN 'bookmarks' WHEN 'signup' THEN 'recent' ELSE 'unknown' END AS kind"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: entries of user state from events, with times cut to the day so that many are equal."""
    e = table(spark, sf_dir, "events")
    day = F.unix_millis(F.date_trunc("day", F.col("ts")).cast("timestamp")).cast("double")
    n = F.get_json_object("props", "$.k").cast("long")
    v = F.when(F.expr("event_type = 'purchase'"), F.format_string('{"at":%d}', F.col("event_id") % 1000)).otherwise((F.col("event_id") % 1000).cast("string"))
    return e.select(*(F.expr(c) for c in _split(_LEDGER)), F.col("user_id").cast("string").alias("key"), v.alias("v"), day.alias("t"), (n % 10 == 0).cast("int").alias("d"), F.col("event_id").alias("seq")).select(F.format_string("book%d", "book_no").alias("book"), "kind", "key", "v", "t", "d", "seq")


LEDGER = """entries AS (
  SELECT 'book' || (user_id % 10) AS book, CASE event_type WHEN 'view' THEN 'marks' WHEN 'click' THEN 'favorites' WHEN 'purchase' THEN 'bookmarks' WHEN 'signup' THEN 'recent' ELSE 'unknown' END AS kind,
    CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type = 'purchase' THEN '{"at":' || (event_id % 1000) || '}' ELSE CAST(event_id % 1000 AS VARCHAR) END AS v,
    CAST(epoch_ms(date_trunc('day', ts)) AS DOUBLE) AS t, CAST(CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS d, event_id AS seq
  FROM events
), latest AS (
  SELECT book, kind, key, CASE WHEN d = 0 THEN v END AS v, t, d, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY book, kind, key ORDER BY t DESC, seq) AS r FROM entries WHERE kind <> 'unknown') WHERE r = 1
)"""


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR anchors of books of 3,000 parts each, some of which jump back: book, answer_page, a, b."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey div 3000 AS book", "p_partkey % 3000 AS k").filter("k % 3 <> 0")
    raw = p.selectExpr("book", "cast(k + 1 as int) AS answer_page", "cast(10 + k div 8 - CASE WHEN k % 13 = 5 THEN 40 ELSE 0 END as int) AS a", "cast(k % 5 as int) AS n")
    return raw.selectExpr("book", "answer_page", "a", "a + n AS b").filter("a BETWEEN 10 AND 295")


ANCHORS = """raw AS (
  SELECT * FROM (SELECT book, k + 1 AS answer_page, 10 + k // 8 - CASE WHEN k % 13 = 5 THEN 40 ELSE 0 END AS a, 10 + k // 8 - CASE WHEN k % 13 = 5 THEN 40 ELSE 0 END + k % 5 AS b
    FROM (SELECT p_partkey // 3000 AS book, p_partkey % 3000 AS k FROM part) WHERE k % 3 <> 0) WHERE a BETWEEN 10 AND 295
), kept AS (
  SELECT book, answer_page, a, b FROM (SELECT *, max(a) OVER (PARTITION BY book ORDER BY answer_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM raw) WHERE a >= coalesce(m, 0)
)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier replies, of which some are no JSON, of an unknown type, or with a confidence that is a text."""
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", f"{_REPLY} AS raw")


_REPLY = """CASE event_id % 8 WHEN 0 THEN 'no braces here' WHEN 1 THEN concat('sure: {"type": "formula", "confidence": 0.', cast(event_id % 10 as string), '} done')
  WHEN 2 THEN '{"type": "poem", "confidence": 0.9}' WHEN 3 THEN '{"type": "text", "confidence": }' WHEN 4 THEN '{"type": "figure", "confidence": "0.75"}'
  WHEN 5 THEN '{"type": "table"}' WHEN 6 THEN '{"type": "problem_number", "confidence": "high"}' ELSE concat('{"type": "text", "confidence": 0.5', cast(event_id % 10 as string), '}') END"""
REPLIES = f"replies AS (SELECT event_id AS id, {_REPLY.replace('as string', 'as varchar')} AS raw FROM events)"


_HEIGHT = "CASE WHEN n % 11 = 5 THEN 14 ELSE 10 END"


def text_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length rows (page, y, x0, x1, tint) of all of documents' lines, of which a third is left out to make gaps.

    A character is 10 wide; a line takes 18 rows, of which 11 have ink, or 15 of a tall one. Some lines begin with a label, before a
    wide gap or in the colour of problem numbers (tint).
    """
    docs = _lines(spark, sf_dir).filter("n % 3 <> 0")
    run = lambda x0, x1, tint=0: F.struct(F.lit(x0).cast("long").alias("x0"), x1.cast("long").alias("x1"), F.lit(tint).cast("long").alias("tint"))
    n, middle, label = F.col("n"), F.expr("10 * (n div 2)"), F.lit(30)
    gap, coloured = F.array(run(0, label), run(60, middle), F.struct((middle + 10).alias("x0"), (10 * n).alias("x1"), F.lit(0).cast("long").alias("tint"))), F.array(run(0, label, 30), run(40, 10 * n))
    spans = F.when((n >= 30) & (n % 5 == 1), gap).when((n >= 30) & (n % 5 == 2), coloured).otherwise(F.array(run(0, 10 * n)))
    runs = docs.select("page", "row", "n", F.inline(spans))
    return runs.selectExpr("page", f"explode(sequence(row * 18, row * 18 + {_HEIGHT})) AS y", "x0", "x1", "tint")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id AS page", "posexplode(split(text, '\\n')) AS (row, line)").selectExpr("page", "cast(row AS bigint) AS row", "cast(length(line) AS bigint) AS n")


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page, width, height: of the text's longest line and of all its lines."""
    return _lines(spark, sf_dir).groupBy("page").agg((10 * F.max("n")).alias("width"), (18 * (F.max("row") + 1)).alias("height"))


GRID = f"""r AS (SELECT doc_id AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents WHERE text IS NOT NULL),
size AS (SELECT page, 10 * max(length(line)) AS width, 18 * (max(row) + 1) AS height FROM r GROUP BY page), kept AS (SELECT page, row, CAST(length(line) AS BIGINT) AS n FROM r WHERE length(line) % 3 <> 0),
lruns AS (SELECT page, row, n, 0 AS x0, CASE WHEN n >= 30 AND n % 5 IN (1, 2) THEN 30 ELSE 10 * n END AS x1, CASE WHEN n >= 30 AND n % 5 = 2 THEN 30 ELSE 0 END AS tint FROM kept
  UNION ALL SELECT page, row, n, 60, 10 * (n // 2), 0 FROM kept WHERE n >= 30 AND n % 5 = 1 UNION ALL SELECT page, row, n, 10 * (n // 2) + 10, 10 * n, 0 FROM kept WHERE n >= 30 AND n % 5 = 1
  UNION ALL SELECT page, row, n, 40, 10 * n, 0 FROM kept WHERE n >= 30 AND n % 5 = 2),
grid AS (SELECT page, unnest(generate_series(row * 18, row * 18 + {_HEIGHT})) AS y, x0, x1, tint FROM lruns)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels (id, level) of embeddings as 8 by 8 pictures of levels 0 to 255."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.explode("embedding").alias("v"))
    return v.select("id", F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("v").cast("double"))) + 0.5) * 255).cast("long").alias("level"))


RASTER = "pixels AS (SELECT vec_id AS id, CAST(floor((greatest(-0.5, least(0.5, CAST(v AS DOUBLE))) + 0.5) * 255) AS BIGINT) AS level FROM (SELECT vec_id, unnest(embedding) AS v FROM embeddings))"


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, width, height, pixels: embeddings as pictures of 8 by 8 grey levels in reading order."""
    level = lambda v: F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v.cast("double"))) + 0.5) * 255).cast("int")
    v = table(spark, sf_dir, "embeddings").filter("size(embedding) = 64")
    return v.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.transform("embedding", level).alias("pixels"))


def colour_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, p, blue, green, red: each pixel's channels are the levels at p, p + 21 and p + 42."""
    at = lambda k: F.get("pixels", (F.col("p") + k) % 64).alias
    each = pictures(spark, sf_dir).select("id", "pixels", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return each.select("id", "p", at(0)("blue"), at(21)("green"), at(42)("red"))


def colour_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as pictures whose pixels are blue, green and red of each."""
    each = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: F.array(*(F.get("pixels", (p + k) % 64) for k in (0, 21, 42))))
    return pictures(spark, sf_dir).withColumn("pixels", F.flatten(each))


PICTURES = "px AS (SELECT vec_id AS id, i - 1 AS p, (i - 1) % 8 AS x, (i - 1) // 8 AS y, CAST(floor((greatest(-0.5, least(0.5, CAST(embedding[i] AS DOUBLE))) + 0.5) * 255) AS BIGINT) AS level FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings WHERE len(embedding) = 64))"
COLOURS = f"{PICTURES}, colours AS (SELECT b.id, b.p, b.x, b.y, b.level AS blue, g.level AS green, r.level AS red FROM px b JOIN px g ON g.id = b.id AND g.p = (b.p + 21) % 64 JOIN px r ON r.id = b.id AND r.p = (b.p + 42) % 64)"
