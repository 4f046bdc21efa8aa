"""Retrieval measures. rankings(query_id, id, rank), truth(query_id, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def measures(rankings: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row for each query with anything relevant: recall and its ceiling, nDCG, reciprocal rank, average precision, first hit.

    A query without a hit has its first hit after the list's end.
    """
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return measured(rankings, rankings.join(truth, ["query_id", "id"], "left_semi"), sizes, k)


def measured(rankings: DataFrame, hits: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """measures() where the truth is too large to list: hits(query_id, id, rank) of the rankings, sizes(query_id, n) of the truth."""
    ends = rankings.groupBy("query_id").agg((F.max("rank") + 1).alias("end"))
    hits = hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    g = hits.groupBy("query_id").agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("within"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.col("nth") / F.col("rank")).alias("precision"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    both = sizes.join(g, "query_id", "left").join(ends, "query_id", "left")
    return both.select(
        "query_id",
        (F.coalesce("within", F.lit(0)) / F.col("n")).alias("recall"),
        (F.least(F.col("n"), F.lit(k)) / F.col("n")).alias("ceiling"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        (F.coalesce("precision", F.lit(0.0)) / F.col("n")).alias("ap"),
        F.coalesce("first", "end").alias("first_hit"),
    )


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("recall").alias("recall"), F.avg("ceiling").alias("ceiling"), F.avg("ndcg").alias("ndcg"), F.avg("rr").alias("mrr"), F.avg("ap").alias("map"), F.max("first_hit").alias("worst"))


def without(rankings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rankings without the excluded rows, closed up. excluded(query_id, id)."""
    kept = rankings.join(excluded, ["query_id", "id"], "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id")))


def usable(truth: DataFrame, corpus: DataFrame) -> DataFrame:
    """Truth that the corpus has; queries without any are gone."""
    return truth.join(corpus.select("id").distinct(), "id", "left_semi")


def weak_cases(records: DataFrame, take: int = 3, least: int = 4) -> DataFrame:
    """(query_id, query, id): evenly spaced messages of a thread as queries, its other messages as truth.

    records(id, thread_ts, pos, text). Threads of fewer than ``least`` messages give none.
    """
    w = Window.partitionBy("thread_ts")
    placed = records.withColumn("k", F.row_number().over(w.orderBy("pos")) - 1).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") >= least)
    step = F.greatest(F.floor(F.col("n") / take), F.lit(1))
    asked = placed.where((F.col("k") % step == 0) & (F.col("k") / step < take)).select(F.col("id").alias("query_id"), F.col("text").alias("query"), "thread_ts")
    return asked.join(placed.select("id", "thread_ts"), "thread_ts").where("id != query_id").select("query_id", "query", "id")


def training_pairs(records: DataFrame, most: int = 20) -> DataFrame:
    """(thread_ts, a, b, held_out): pairs within a thread, the first ``most``; threads are split by their hash, 15 in 100 held out."""
    pairs = records.alias("x").join(records.alias("y"), "thread_ts").where("x.pos < y.pos").select("thread_ts", F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.pos").alias("pa"), F.col("y.pos").alias("pb"))
    first = pairs.withColumn("k", F.row_number().over(Window.partitionBy("thread_ts").orderBy("pa", "pb"))).where(F.col("k") <= most)
    return first.select("thread_ts", "a", "b", (F.pmod(F.xxhash64("thread_ts"), F.lit(100)) < 15).alias("held_out"))


def separation(moments: DataFrame) -> DataFrame:
    """One row: mean and deviation of similarity within and across groups, and their gap in deviations. moments(same, pairs, total, squares)."""
    own = lambda c, same: F.sum(F.when(F.col("same") == same, F.col(c)))
    deviation = lambda n, t, q: F.sqrt(F.greatest(q / n - (t / n) * (t / n), F.lit(0.0)))
    parts = {name: [own(c, same) for c in ("pairs", "total", "squares")] for name, same in (("same", True), ("other", False))}
    columns = [x for name, (n, t, q) in parts.items() for x in ((t / n).alias(f"{name}_mean"), deviation(n, t, q).alias(f"{name}_std"))]
    g = moments.agg(*columns, deviation(F.sum("pairs"), F.sum("total"), F.sum("squares")).alias("spread"))
    pooled = F.sqrt((F.col("same_std") * F.col("same_std") + F.col("other_std") * F.col("other_std")) / 2)
    return g.withColumn("separation", F.when(pooled > 0, (F.col("same_mean") - F.col("other_mean")) / pooled))


def histogram(moments: DataFrame) -> DataFrame:
    """(same, bin, pairs) of similarities."""
    return moments.groupBy("same", "bin").agg(F.sum("pairs").alias("pairs"))


def found_by_depth(ranks: DataFrame, truth: DataFrame, depths: list[int]) -> DataFrame:
    """(depth, found, total, reachable, first_correct): over all queries, how much of what is relevant the first ranks hold.

    reachable is what a ranking of that depth could hold at most. ranks(query_id, id, rank), truth(query_id, id).
    """
    known = truth.distinct()
    return depths_of(ranks.join(known, ["query_id", "id"]), known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), depths)


def depths_of(hits: DataFrame, sizes: DataFrame, depths: list[int]) -> DataFrame:
    """found_by_depth() where the truth is too large to list: hits(query_id, rank) of the rankings, sizes(query_id, n) of the truth."""
    hits, totals = hits.select("query_id", "rank"), sizes.select("query_id", F.col("n").alias("total"))
    at = F.explode(F.array(*map(F.lit, depths))).alias("depth")
    found = hits.select("rank", at).groupBy("depth").agg(F.count(F.when(F.col("rank") <= F.col("depth"), 1)).alias("found"))
    first = hits.where("rank = 1").agg(F.count(F.lit(1)).alias("first_correct"))
    most = totals.select("total", at).groupBy("depth").agg(F.sum("total").alias("total"), F.sum(F.least("total", "depth")).alias("reachable"))
    return most.join(found, "depth", "left").crossJoin(F.broadcast(first)).select("depth", F.coalesce("found", F.lit(0)).alias("found"), "total", "reachable", "first_correct")


def label_counts(cases: DataFrame, threads: DataFrame) -> DataFrame:
    """One row: different pairs, queries and threads of weak labels. cases(query_id, id), threads(query_id, thread_ts)."""
    return cases.join(threads, "query_id").agg(F.countDistinct("query_id", "id").alias("pairs"), F.countDistinct("query_id").alias("queries"), F.countDistinct("thread_ts").alias("threads"))
