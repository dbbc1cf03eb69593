"""URL filters whose list entries have dates: a capture is judged by the entries in force when it was fetched.

A list is a log of dated entries (entry, action, since). An entry is a host or domain, which holds for its
subdomains too, or a host and a first path segment ("host/segment"), both without regard to case. Of one entry, each row is in force
from its date up to the next row's date: a validity interval. Actions are "block", "allow" and "drop"
(delisted). Rows of one entry with one date: the action last in the alphabet counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

#: A list whose intervals take at most so many bytes is broadcast; a longer one is joined by shuffle, in SALTS copies, so that no host's captures meet in one task.
BROADCAST_BYTES = 8 << 20
SALTS = 16


def host_of(url: Column) -> Column:
    """The host in lower case, without full stops at its end."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """The entries that can match a URL: its host and all its parent domains of two labels or more, and host/first path segment."""
    host = host_of(url)
    segment = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)", 1))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(domains, path))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """entry, spans: per entry its validity intervals (since, until, action), ascending; until is null for the last. Rows without entry, action or date are left out."""
    rows = entries.select(F.lower(F.trim("entry")).alias("entry"), "action", "since").filter("entry is not null and action is not null and since is not null")
    dated = rows.groupBy("entry", "since").agg(F.max("action").alias("action"))
    packed = dated.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("since", "action"))).alias("d"))
    spans = F.transform("d", lambda x, i: F.struct(x["since"].alias("since"), F.get(F.transform("d", lambda y: y["since"]), i + 1).alias("until"), x["action"].alias("action")))
    return packed.select("entry", spans.alias("spans"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """key, url, fetched, blocked, entry, action, since, until: for each distinct (key, url, fetched) the longest entry in force that matches.

    Of entries of equal length the one last in the alphabet counts. Without any entry in force, and for null or unparsable URLs
    and null times, nothing is blocked and the other columns are null. Empty tables are fine.
    """
    caught = captures.select(F.col(key).alias("__k"), F.col(url).alias("__u"), F.col(fetched).alias("__t")).distinct()
    spans = written(intervals(entries), "intervals")
    size = spans.agg(F.sum(F.octet_length("entry") + 48 * F.size("spans"))).first()[0] or 0
    single = F.explode_outer(keys_of(F.col("__u"))).alias("entry")
    if size <= BROADCAST_BYTES:
        met = caught.select("__k", "__u", "__t", single).join(F.broadcast(spans), "entry", "left")
    else:
        left = caught.select("__k", "__u", "__t", single).withColumn("__s", F.pmod(F.xxhash64("__k", "__u", "__t"), F.lit(SALTS)))
        right = spans.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = left.join(right.hint("shuffle_merge"), ["entry", "__s"], "left")
    now = F.filter("spans", lambda x: (x["since"] <= F.col("__t")) & (x["until"].isNull() | (F.col("__t") < x["until"])) & (x["action"] != "drop"))
    hit = F.get(now, 0)
    best = met.withColumn("hit", hit).groupBy("__k", "__u", "__t").agg(F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("entry").alias("n"), "entry", "hit"))).alias("b"))
    return best.select(
        F.col("__k").alias(key), F.col("__u").alias(url), F.col("__t").alias(fetched), F.coalesce(F.col("b.hit.action") == "block", F.lit(False)).alias("blocked"),
        F.col("b.entry").alias("entry"), F.col("b.hit.action").alias("action"), F.col("b.hit.since").alias("since"), F.col("b.hit.until").alias("until"),
    )
