"""What an operator needs from the running session: input tables, the shared folder, importable workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver runs from another folder."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [ROOT, *paths] if p)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store Spark knows will do."""
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a local one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tasks on a cluster need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lodestar-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created yet."""
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def _home(spark: SparkSession) -> str:
    return f"{shared_root(spark).rstrip('/')}/lodestar/{spark.sparkContext.applicationId}"


def cleanup(spark: SparkSession) -> None:
    """Delete what this application has written below the shared folder; results not yet saved elsewhere go with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame once to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
