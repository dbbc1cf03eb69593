"""Intermediate tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: All tables of one driver process stand in a folder of their own.
_RUN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in local mode where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, it is computed once, and a lost executor takes nothing of it along."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire/{_RUN}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._quire_path = path
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def close(spark: SparkSession) -> None:
    """Delete all tables that this process has staged; call it when no result that reads them is needed any more."""
    delete(spark, f"{shared_folder(spark)}/quire/{_RUN}")
