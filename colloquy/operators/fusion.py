"""Rank and score fusion, and reranking by shared neighbourhoods. Scores are tables (query_id, id, stage, score)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import written

#: Fixed value: damping of reciprocal ranks.
DAMPING = 60


def competition_rank(score: Column, *by: str) -> Column:
    """1, 1, 3: equal scores share the best rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9))))


def reciprocal(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, id, score): the weighted sum of 1 / (60 + rank) over stages."""
    w = F.lit(1.0)
    for stage, value in (weights or {}).items():
        w = F.when(F.col("stage") == stage, F.lit(value)).otherwise(w)
    return ranked.groupBy("query_id", "id").agg(F.sum(w / (DAMPING + F.col("rank"))).alias("score"))


@dataclass
class Stage:
    """What reciprocal_best asks of a stage: head(queries, m) has the m best records of each query as (query_id, id, score), ties to the smaller id; of(pairs)

    the scores of given pairs(query_id, id); above(queries, scores) how many records score more than each of scores(query_id, score), as
    (query_id, score, better), scores to nine places. queries(query_id).

    A stage that knows the ranks of any pairs without counting has exact(pairs), as (query_id, id, rank), in place of the last two. Its
    head may leave out a query's records that all have rank 1, if they are more than m.
    """

    weight: float
    head: Callable[[DataFrame, int], DataFrame]
    of: Callable[[DataFrame], DataFrame] | None = None
    above: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    exact: Callable[[DataFrame], DataFrame] | None = None


def reciprocal_best(stages: list[Stage], queries: DataFrame, k: int, total: int, m: int = 128) -> DataFrame:
    """(query_id, id, score): the k best of each query by reciprocal ranks over all records, exactly, without a row for each pair. queries(query_id).

    Each stage sends its m best. A record in none of these can't score more than one that comes next in every stage, so where
    k of the records sent score at least that, they are the best of all. Of those sent, ranks are counted only for such as
    may be among the k. Queries for which m is too few are asked again with eight times as many.
    """
    out = None
    while True:
        queries = written(queries.select("query_id").distinct())
        heads = []
        for s in stages:
            rank = F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9))))
            heads.append(written(s.head(queries, m).select("query_id", "id", rank.alias("rank"))))
        known, sent, ends = queries, None, []
        for i, h in enumerate(heads):
            end = h.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"n{i}"), F.max("rank").alias(f"end{i}"))
            known = known.join(end, "query_id", "left")
            some = F.coalesce(F.col(f"n{i}"), F.lit(0))
            ends.append(F.when(some < m, some + 1).otherwise(F.col(f"end{i}")).alias(f"end{i}"))
            sent = h.select("query_id", "id") if sent is None else sent.unionByName(h.select("query_id", "id"))
        known = written(known.select("query_id", *[F.coalesce(F.col(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(stages))], *ends))
        each = written(sent.distinct())
        pairs = each
        for i, (s, h) in enumerate(zip(stages, heads, strict=True)):
            each = each.join((s.exact(pairs) if s.exact else h).withColumnRenamed("rank", f"rank{i}"), ["query_id", "id"], "left")
        each = each.join(known, "query_id")
        share = lambda rank: reduce(lambda a, b: a + b, [s.weight / (DAMPING + rank(i)) for i, s in enumerate(stages)])
        counted = [i for i, s in enumerate(stages) if not s.exact]
        open_ = lambda i: F.col(f"rank{i}").isNull() & (F.col(f"n{i}") == m) if i in counted else F.lit(False)
        high = share(lambda i: F.coalesce(f"rank{i}", f"end{i}"))
        low = share(lambda i: F.when(open_(i), F.lit(total + 1)).otherwise(F.coalesce(f"rank{i}", f"end{i}")))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
        each = written(each.withColumn("high", high).withColumn("low", low))
        kth = each.withColumn("p", place).where(F.col("p") == k).select("query_id", F.col("low").alias("kth"))
        some = written(each.join(kth, "query_id", "left").where("kth is null or high >= kth - 1e-9").drop("kth", "high", "low"))
        full = some
        for i in counted:
            s = stages[i]
            asked = written(s.of(some.where(open_(i)).select("query_id", "id")).select("query_id", "id", F.round("score", 9).alias("score")))
            counts = s.above(queries, asked.select("query_id", "score").distinct())
            found = asked.join(counts, ["query_id", "score"], "left").select("query_id", "id", (F.coalesce("better", F.lit(0)) + 1).alias(f"more{i}"))
            full = full.join(found, ["query_id", "id"], "left")
        rank = lambda i: F.coalesce(f"rank{i}", f"more{i}", f"end{i}") if i in counted else F.col(f"rank{i}")
        # a record not sent that ties with the last one sent of a stage has a greater id than that
        tied = reduce(lambda a, b: a | b, [(F.col(f"n{i}") == m) & (F.coalesce(f"rank{i}", F.lit(0)) == F.col(f"end{i}")) for i in counted], F.lit(False))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        bound = F.round(share(lambda i: F.col(f"end{i}")), 9)
        full = full.select("query_id", "id", share(rank).alias("score"), bound.alias("bound"), tied.alias("tied"))
        best = written(full.withColumn("p", F.row_number().over(order)).where(F.col("p") <= k))
        sure = (F.round("score", 9) > F.col("bound")) | (F.round("score", 9) == F.col("bound")) & F.col("tied")
        good = best.groupBy("query_id").agg(F.count_if(sure).alias("good"))
        seen = each.groupBy("query_id").agg(F.count(F.lit(1)).alias("seen"))
        short = queries.join(good, "query_id", "left").join(seen, "query_id", "left").where((F.coalesce("good", F.lit(0)) < k) & (F.coalesce("seen", F.lit(0)) < total))
        short = written(short.select("query_id"))
        done = best.join(short, "query_id", "left_anti").select("query_id", "id", "score")
        out = done if out is None else out.unionByName(done)
        if not short.limit(1).count():
            return out
        queries, m = short, min(8 * m, total)


def z_scores(scored: DataFrame) -> DataFrame:
    """Scores of each stage by population mean and deviation; 0 where all are the same."""
    w = Window.partitionBy("query_id", "stage")
    spread = F.stddev_pop("score").over(w)
    return scored.withColumn("score", F.when(spread < 1e-9, F.lit(0.0)).otherwise((F.col("score") - F.avg("score").over(w)) / spread))


def min_max(score: Column, *by: str) -> Column:
    """From 0 to 1 within a group; 0 where all are the same."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-9, F.lit(0.0)).otherwise((score - low) / (high - low))


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(F.lit(0.0))


def neighbourhood_rerank(scored: DataFrame, neighbours: DataFrame, depth: int = 20, size: int = 10, blend: float = 0.5) -> DataFrame:
    """(query_id, id, score): the best ``depth`` by a blend of their score and of how far their neighbours are the query's best.

    scored(query_id, id, score), neighbours(l, r, rank). Reranked rows stay above all others.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = scored.withColumn("place", F.row_number().over(order))
    asked = ranked.where(F.col("place") <= size).groupBy("query_id").agg(F.collect_set("id").alias("mine"))
    near = neighbours.where(F.col("rank") <= size).groupBy(F.col("l").alias("id")).agg(F.collect_set("r").alias("near"))
    head = ranked.where(F.col("place") <= depth).join(asked, "query_id").join(near, "id", "left")
    around = F.array_union(F.coalesce("near", F.array("id")), F.array("id"))
    head = head.withColumn("overlap", jaccard(F.col("mine"), around))
    mixed = blend * min_max(F.col("score"), "query_id") + (1 - blend) * min_max(F.col("overlap"), "query_id")
    tail = ranked.where(F.col("place") > depth)
    lift = tail.groupBy("query_id").agg((F.max("score") + 1.0).alias("lift"))
    lifted = head.withColumn("score", mixed).join(lift, "query_id", "left").withColumn("score", F.col("score") + F.coalesce("lift", F.lit(0.0)))
    return lifted.select("query_id", "id", "score").unionByName(tail.select("query_id", "id", "score"))


def spliced(scored: DataFrame, reranked: DataFrame) -> DataFrame:
    """Scores with a reranked head put above everything that wasn't reranked."""
    rest = scored.join(reranked.select("query_id", "id"), ["query_id", "id"], "left_anti")
    top = rest.groupBy("query_id").agg(F.max("score").alias("top"))
    low = reranked.groupBy("query_id").agg(F.min("score").alias("low"))
    head = reranked.join(low, "query_id").join(top, "query_id", "left")
    head = head.withColumn("score", F.col("score") - F.col("low") + F.coalesce(F.col("top") + 1.0, F.lit(0.0)))
    return head.select("query_id", "id", "score").unionByName(rest.select("query_id", "id", "score"))
