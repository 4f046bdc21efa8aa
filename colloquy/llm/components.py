"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: Edges of a task at least: rounds over few edges don't leave files for each of very many partitions.
TASK_EDGES = 20_000


def _tasks(edges: int) -> int:
    return max(1, -(-edges // TASK_EDGES))


def _star(edges: DataFrame, small: bool, tasks: int) -> DataFrame:
    """Link each node's neighbours (the smaller ones, or the larger ones) to the least of them and itself."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    least = durable(least.coalesce(tasks))  # so that a hub's neighbours can be split
    near = both.join(least.hint("shuffle_merge"), "u")
    if small:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").coalesce(tasks).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) of long nodes -> (node, root): for each node with an edge, the least node it reaches.

    Self-loops and repeated edges are allowed, null ends are dropped; an empty table gives an empty one.
    Each round writes its edges to the shared folder, so a lost executor costs at most one round. The number
    of rounds grows with the logarithm of the longest path.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = durable(now)
    tasks = _tasks(now.count())  # rounds don't add edges
    now = now.coalesce(tasks)
    sums = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
    before = None
    for _ in range(most_rounds):
        seen = tuple(now.agg(*sums).first())
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = seen
        now = durable(_star(_star(now, False, tasks), True, tasks).coalesce(tasks))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
