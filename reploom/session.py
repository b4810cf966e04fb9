"""Session helpers: table access, the shared checkpoint folder, running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One test table; only the named columns are read when any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master without any, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="reploom-ckpt-"))
    return sc.getCheckpointDir()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so later steps survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def running_total(df: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """df plus the running sum of amount in the order of a column of distinct values, without bringing all rows into one task.

    Rows are range-partitioned and materialised; each range adds the total of the ranges before it, of which there are as many as partitions.
    """
    ranged = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = totals.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside: Column = F.sum(amount).over(Window.partitionBy("_part").orderBy(order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, inside + F.col("_before")).drop("_part", "_before")
