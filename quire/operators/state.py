"""Last-write-wins user state: ST1-ST9, ST11, S15, S18, A13, U10, P15, P17, O4, O5, S16, E17-E19.

Entries are rows (book, kind, key, v, t, d, seq): v a JSON text, t the time in milliseconds, d 1 for a
tombstone, seq the order of arrival. A key's entry of the largest t counts, of equal t the first to arrive.
Tombstones are rows and never go; a live entry may hold JSON null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.text import KINDS

KEY = ["book", "kind", "key"]
STORED = "book string, kind string, key string, v string, t double, d int, seq long"


def accepted(entries: DataFrame) -> DataFrame:
    """Of a known kind with a number as time; NaN is no time."""
    return entries.filter(F.col("kind").isin(KINDS) & F.col("t").isNotNull() & ~F.isnan(F.col("t").cast("double")))


def latest(entries: DataFrame) -> DataFrame:
    """ST1, A13: the entry that counts for each key, with null v where deleted. Partial maxima are combined before the shuffle."""
    best = entries.groupBy(*KEY).agg(F.max_by(F.struct("v", "t", "d", "seq"), F.struct(F.col("t"), -F.col("seq"))).alias("e"))
    return best.select(*KEY, F.when(F.col("e.d") == 0, F.col("e.v")).alias("v"), F.col("e.t").alias("t"), F.col("e.d").alias("d"), F.col("e.seq").alias("seq"))


def merged(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """ST2, ST4, U10: the whole state after a request; stored entries arrived before all incoming ones."""
    old = stored.withColumn("seq", F.col("seq") - F.lit(1 << 40))
    return latest(old.unionByName(accepted(incoming).select(stored.columns))).withColumn("seq", F.when(F.col("seq") < 0, F.col("seq") + F.lit(1 << 40)).otherwise(F.col("seq")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """ST2: keys whose entry is new or newer."""
    return after.join(before.select(*KEY, F.col("t").alias("__t")), KEY, "left").filter(F.col("__t").isNull() | (F.col("t") > F.col("__t"))).select(*KEY)


def reconciled(local: DataFrame, server: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ST6: (local, server) after a pull and then a push. Of equal times each side keeps what it had."""
    pulled = merged(local, server)
    return pulled, merged(server, pulled)


def pushes(changes: DataFrame, wait: int = 800) -> DataFrame:
    """ST5: book, at: when the ledger is sent: `wait` milliseconds after a change (book, t in milliseconds) that no other one of the book follows within that time."""
    later = F.lead("t").over(W.partitionBy("book").orderBy("t"))
    return changes.select("book", "t").distinct().withColumn("__n", later).filter(F.col("__n").isNull() | (F.col("__n") - F.col("t") >= wait)).select("book", (F.col("t") + wait).alias("at"))


def from_ledger(text: Column) -> Column:
    """A stored ledger as an array of entries (kind, key, v as JSON text, t, d): unknown kinds and what is no object are dropped; bad JSON gives none."""
    kinds = F.from_json(text, "map<string,string>")
    entry = "struct<v:string,t:double,d:int>"

    def of(kind: str) -> Column:
        items = F.map_entries(F.from_json(F.try_element_at(kinds, F.lit(kind)), f"map<string,{entry}>"))
        made = F.transform(items, lambda e: F.struct(F.lit(kind).alias("kind"), e["key"].alias("key"), e["value"]["v"].alias("v"), e["value"]["t"].alias("t"), F.coalesce(e["value"]["d"], F.lit(0)).alias("d")))
        return F.coalesce(made, F.array().cast("array<struct<kind:string,key:string,v:string,t:double,d:int>>"))

    return F.concat(*(of(k) for k in KINDS))


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The state stored at path; an empty one is written first where there is none."""
    spark.createDataFrame([], STORED).write.mode("ignore").parquet(path)
    return spark.read.schema(STORED).parquet(path)


def of_book(state: DataFrame, book: str) -> DataFrame:
    """All of one book, tombstones too."""
    return state.filter(F.col("book") == book)


def live(state: DataFrame) -> DataFrame:
    """P17, ST8."""
    return state.filter(F.coalesce("d", F.lit(0)) == 0)


def tombstones(keys: DataFrame, now: Column) -> DataFrame:
    """ST3."""
    return keys.select(*KEY, F.lit(None).cast("string").alias("v"), now.cast("double").alias("t"), F.lit(1).alias("d"))


def toggled(state: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """ST11: favourites: what is live gets a tombstone, all else is set."""
    on = live(state).select(*KEY, F.lit(True).alias("__on"))
    met = keys.select(*KEY).distinct().join(on, KEY, "left")
    off = F.coalesce("__on", F.lit(False))
    return met.select(*KEY, F.when(~off, F.lit("true")).alias("v"), now.cast("double").alias("t"), off.cast("int").alias("d"))


def added(state: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """ST11: bookmarks: only where nothing is live, with the time as their value."""
    new = keys.select(*KEY).distinct().join(live(state).select(*KEY), KEY, "left_anti")
    return new.select(*KEY, F.to_json(F.struct(now.cast("long").alias("at"))).alias("v"), now.cast("double").alias("t"), F.lit(0).alias("d"))


def recent(state: DataFrame, most: int = 20) -> DataFrame:
    """Per book the latest visits: largest v first (null as 0), ties by ascending number of the key."""
    w = W.partitionBy("book").orderBy(F.coalesce(F.col("v").try_cast("double"), F.lit(0.0)).desc(), F.col("key").try_cast("long"), "key")
    return live(state).filter("kind = 'recent'").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def bookmarks(state: DataFrame) -> DataFrame:
    """Per book, latest first by the at of their values, ties by ascending key."""
    at = F.get_json_object("v", "$.at").try_cast("double")
    w = W.partitionBy("book").orderBy(F.coalesce(at, F.lit(0.0)).desc(), F.col("key").try_cast("long"), "key")
    return live(state).filter("kind = 'bookmarks'").withColumn("rank", F.row_number().over(w))


def favourites(state: DataFrame) -> DataFrame:
    """Per book, by ascending number."""
    w = W.partitionBy("book").orderBy(F.col("key").try_cast("long"), "key")
    return live(state).filter("kind = 'favorites'").withColumn("rank", F.row_number().over(w))


def split_marks(state: DataFrame) -> DataFrame:
    """Book, page, number, mark of live marks."""
    parts = F.split("key", ":")
    return live(state).filter("kind = 'marks'").select("book", F.get(parts, 0).try_cast("int").alias("page"), F.get(parts, 1).try_cast("int").alias("number"), F.col("v").alias("mark"))


def legacy(book: Column, favourites_: Column, recent_: Column, marks: Column, now: Column) -> Column:
    """ST7: old arrays as an array of entries: favourites set, the i-th recent page visited now - i, old marks done."""
    entry = lambda kind, key, v, t: F.struct(book.alias("book"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), v.cast("string").alias("v"), t.cast("double").alias("t"), F.lit(0).alias("d"))
    return F.concat(
        F.transform(favourites_, lambda p: entry("favorites", p, F.lit("true"), now)),
        F.transform(recent_, lambda p, i: entry("recent", p, now - i, now - i)),
        F.transform(marks, lambda m: entry("marks", m, F.lit('"done"'), now)),
    )


def from_payload(payload: DataFrame) -> DataFrame:
    """Rows (book, seq, state: map<kind, map<key, struct<v, t, d>>>) as entries; all items of one request arrive in order of kind and key."""
    kinds = payload.select("book", "seq", F.explode("state").alias("kind", "items"))
    items = kinds.select("book", "seq", "kind", F.explode("items").alias("key", "e"))
    return items.select("book", "kind", "key", F.col("e.v").alias("v"), F.col("e.t").alias("t"), F.coalesce(F.col("e.d"), F.lit(0)).alias("d"), "seq")


def to_payload(state: DataFrame) -> DataFrame:
    """ST4: book, state as JSON; keys and tombstones included."""
    items = state.groupBy("book", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", F.struct("v", "t", "d").alias("e"))))).alias("items"))
    return items.groupBy("book").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("kind", "items")))).alias("state"))
