"""Connected components of a graph by least labels, spread and then followed, for graphs of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests on one machine, a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="colloquy-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder: later plans begin there, and a lost executor costs no more than what came after."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The same as Parquet: in a long iteration, nothing that is known of earlier rounds' columns piles up in later plans."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(graph: DataFrame, most_rounds: int = 60) -> DataFrame:
    """graph(l, r) -> (id, component): the least id that each node with an edge reaches.

    Each round gives a node the least label around it, and then that label's own label, so that the number of rounds
    grows with the logarithm of a path's length. Labels are written to the checkpoint folder after each round.
    """
    both = graph.select("l", "r").unionByName(graph.select(F.col("r").alias("l"), F.col("l").alias("r"))).distinct()
    both = written(both)
    labels = written(both.groupBy(F.col("l").alias("id")).agg(F.least(F.min("l"), F.min("r")).alias("component")))
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("id").alias("r"), F.col("component").alias("c")), "r").groupBy(F.col("l").alias("id")).agg(F.min("c").alias("c"))
        nearer = labels.join(around, "id").select("id", "component", F.least("component", "c").alias("c"))
        follow = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        fresh = written(nearer.join(follow, "c", "left").select("id", F.least("c", F.coalesce("further", "c")).alias("component"), (F.least("c", F.coalesce("further", "c")) < F.col("component")).alias("moved")))
        labels = fresh.select("id", "component")
        if not fresh.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
