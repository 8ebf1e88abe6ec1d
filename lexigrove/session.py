"""Spark session and tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession

#: Settings a job wants whatever the size of the cluster; sizes of partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "200",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, app: str = "lexigrove", **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(rows: int, each: int) -> int:
    """As many partitions as `rows` ask for at `each` a partition, so that a task sorts as much in tables of all sizes."""
    return max(1, ceil(rows / each))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: `spark.checkpoint.dir`; where it is unset, in local runs alone, one of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrove-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again.

    The plan is cut there: a lost executor costs a re-read, not a recomputation, and later steps know the true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexigrove/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Staged tables that no later step reads are deleted; other DataFrames are left alone."""
    for t in tables:
        path = t.__dict__.get("staged_path") if t is not None else None
        if path:
            spark = t.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
