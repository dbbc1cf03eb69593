"""From raw documents to packed sequences: toxic documents go, then exact and near duplicates, then repeated passages; what stays is packed.

Each stage gets all that the stage before it kept and sees its own input only. Stages are joined by
tables in the shared folder, so a lost executor costs no finished stage.

All stages take null and empty texts (as empty ones), repeated rows and null ids (each row is a document of its own; of
equal ones a deduplicating stage keeps one), empty tables, and further columns of any name, which pass unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import lsm_dedup, packing, partenum, rindex, toxicity
from quire.llm.common import give_back, ready, written

TOXIC = 0.7
SEQUENCE = 2048


def _begin(spark: SparkSession) -> None:
    """ready(), and without the heap that executors have left from the stage before."""
    ready(spark)
    give_back(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; fitted on the labels that op6 learns from, as far as their documents are here."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels, lambda key: F.crc32(key.cast("string")) % 3 == 1)
    score = "score"
    while score in docs.columns:
        score = f"_{score}"
    return toxicity.score_toxicity(docs, model, out=score).filter(F.col(score) < TOXIC).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    _begin(spark)
    return lsm_dedup.exact_dedup(docs, keep="max")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id."""
    _begin(spark)
    return partenum.near_dedup(docs)


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 200-byte strings that stand elsewhere too."""
    _begin(spark)
    return rindex.strip_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    _begin(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("repeated_passages", strip_passages),
    ("best_fit_packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
