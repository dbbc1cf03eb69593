"""One query per operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import ann, bpe, chat, lsm_dedup, packing, partenum, quality, rindex, toxicity, url_lists
from quire.llm.common import ready

SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.bpe_encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.bpe_decode(encoded.select("doc_id", "ids"), ranks, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality score of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def held_out(key):
        return F.crc32(key.cast("string")) % 5 == 0

    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"), held_out, level=0.3)
    scored = quality.score_quality(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every vector whose id is divisible by 20, among all others."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0, 20)


def op5_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents; the largest doc_id stays."""
    found = lsm_dedup.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


SQL["op5_lsm_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactual-regularised toxicity score of every document."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")

    def held_out(key):
        return F.crc32(key.cast("string")) % 3 == 1

    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"), held_out)
    scored = toxicity.score_toxicity(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target expansion of every conversation and of one that says the template's control strings."""
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    return chat.read_back(chat.expand_prefix_targets(table.unionByName(own)))


SQL["op7_chat_prefix_targets"] = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS r,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS t
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), sized AS (
  SELECT *, sum(length(r) + length(t) + length('<s>[INST]') + length('[/INST]') + length('</s>'))
    OVER (PARTITION BY conv_id ORDER BY i) AS upto
  FROM numbered
)
SELECT conv_id, CAST(max(n) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op8_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that stand elsewhere too."""
    found = rindex.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document tokenised, cut where longer than a sequence, and packed."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op10_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return partenum.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


# A dated list for the pages' hosts (entry, action, since).
URL_LIST = [
    ("cheap-pills.example.com", "block", "2024-01-10"),
    ("cheap-pills.example.com", "drop", "2024-05-01"),
    ("cheap-pills.example.com", "block", "2024-07-15"),
    ("spam-farm.example.org", "block", "2024-02-01"),
    ("spam-farm.example.org/de", "allow", "2024-03-01"),
    ("tionsh.example.net", "block", "2024-04-01"),
    ("tionsh.example.net", "drop", "2024-06-01"),
    ("blog.tionsh.example.net", "allow", "2024-05-01"),
    ("ththth.example.org", "block", "2024-03-10"),
    ("example.net", "block", "2024-11-01"),
    ("thther.example.org/fr", "block", "2024-01-01"),
    ("tiontion.example.com", "block", "2024-08-01"),
    ("tiontion.example.com", "drop", "2024-08-01"),
    ("tionble.example.com", "block", "2024-09-01"),
    ("m.tiontion.example.com", "block", "2024-02-15"),
]


def op3_url_asof_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list as of its time: minute page_id * 7919 mod 527040 of 2024, as the table has no fetch times."""
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    minute = (F.col("page_id") * 7919 % 527040).cast("int")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", (start + F.make_dt_interval(mins=minute)).alias("fetched"))
    entries = spark.createDataFrame(URL_LIST, "entry string, action string, since string").withColumn("since", F.col("since").cast("timestamp_ntz"))
    return url_lists.judge(pages, entries)


SQL["op3_url_asof_lists"] = rf"""
WITH list AS (
  SELECT entry, max(action) AS action, CAST(since AS TIMESTAMP) AS since
  FROM (VALUES {", ".join(f"('{e}', '{a}', '{s}')" for e, a, s in URL_LIST)}) v(entry, action, since) GROUP BY entry, since
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY entry ORDER BY since) AS until FROM list
), captures AS (
  SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 527040) AS fetched,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '\.+$', '') AS host,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^/?#]+)', 1)) AS segment
  FROM pages
), hits AS (
  SELECT c.page_id, c.url, c.fetched, max({{'n': length(s.entry), 'entry': s.entry, 'action': s.action, 'since': s.since, 'until': s.until}}) AS b
  FROM captures c JOIN spans s
    ON s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until) AND s.action <> 'drop'
    AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry) OR (c.segment <> '' AND c.host || '/' || c.segment = s.entry))
  GROUP BY ALL
)
SELECT c.page_id, c.url, c.fetched, coalesce(b.action = 'block', FALSE) AS blocked, b.entry AS entry, b.action AS action, b.since AS since, b.until AS until
FROM captures c LEFT JOIN hits h ON c.page_id IS NOT DISTINCT FROM h.page_id AND c.url IS NOT DISTINCT FROM h.url
"""
