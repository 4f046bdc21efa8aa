"""The driver's tables, and records made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, over as many tasks as there are cores: one file of a few row groups would be one task's work."""
    scan, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat records. The table has no times: a conversation begins an hour after the one before, turns are a minute apart."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.format_string("msg_%d_%d", "conv_id", "turn").alias("id"),
        F.format_string("C%d", F.pmod("conv_id", F.lit(5))).alias("channel_id"),
        (F.col("conv_id") * 3600.0 + F.col("turn") * 60.0).alias("ts"),
        F.col("conv_id").cast("string").alias("thread_ts"),
        F.col("role").alias("user"),
        "text",
        F.lit("slack").alias("source"),
        "conv_id",
        "turn",
    )
