"""Decisions that supersede each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigrams
from .fusion import jaccard
from .graphs import written

#: Fixed value: how alike two decisions are when the later one supersedes the earlier.
ALIKE = 0.25


def chains(decisions: DataFrame) -> DataFrame:
    """(start, id, step): each decision's chain of successors, by superseded_by, to its end; a cycle ends where it closes.

    Ids are unique. Chains grow to twice their length in each round, by links that lead twice as far, and each round is
    written; so the rounds are as many as the longest chain's length has binary digits. A successor that is reached
    again, round a cycle, keeps its first step.
    """
    found = written(decisions.select(F.col("id").alias("start"), "id", F.lit(0).cast("bigint").alias("step")))
    hops = written(decisions.where("superseded_by is not null").select("id", F.col("superseded_by").alias("to")))
    known, length = found.count(), 1
    while True:
        further = found.join(hops, "id").select("start", F.col("to").alias("id"), (F.col("step") + length).alias("step"))
        found = written(found.unionByName(further).groupBy("start", "id").agg(F.min("step").alias("step")))
        if (now := found.count()) == known:
            return found
        known, length = now, 2 * length
        hops = written(hops.alias("a").join(hops.alias("b"), F.expr("a.to = b.id")).select("a.id", "b.to"))


def superseded(decisions: DataFrame) -> DataFrame:
    """(id, superseded_by): the first later decision, in list order, that is alike enough. decisions(id, pos, at, text, topic).

    Only decisions of one topic are compared, so pairs meet on an equal key.
    """
    d = decisions.withColumn("g", F.array_distinct(trigrams(F.col("text"))))
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, F.expr("a.topic = b.topic and a.pos < b.pos and b.at > a.at")).where(jaccard(F.col("a.g"), F.col("b.g")) > ALIKE)
    return pairs.groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.id", "b.pos").alias("superseded_by"))
