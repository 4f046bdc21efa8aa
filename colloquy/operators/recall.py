"""Recall without an encoder: character counts, shared words and recency; decisions with what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigrams
from ..functions.when import recency
from . import sparse
from .decisions import chains
from .graphs import stored

#: Shares of character counts and of words, for messages and for decisions; the least that is a match.
MESSAGE, DECISION, FLOOR = (0.65, 0.35), (0.7, 0.3), 0.04
#: How much recency counts, and what an answer holds of each.
RECENT, HITS, DECISIONS, ANSWERED = 0.1, 8, 3, 6


def words(text: Column) -> Column:
    """Latin words and numbers of three characters or more, once each."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9._-]{2,}"), F.lit(0)))


def _counted(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(key, g, name) counts of each run of three characters, and (key, size) their length as a vector."""
    each = rows.select(key, F.explode(trigrams(F.col("text"))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).cast("double").alias(name))
    return each, each.groupBy(key).agg(F.sqrt(F.sum(F.col(name) * F.col(name))).alias(f"{name}_size"))


def content(docs: DataFrame, queries: DataFrame, shares: tuple[float, float]) -> DataFrame:
    """(query_id, id, content): shares of the cosine of character counts and of the query's words that a text has.

    docs(id, text), queries(query_id, text). Pairs that have neither in common are not there.
    """
    a, a_size = _counted(docs, "id", "n")
    b, b_size = _counted(queries, "query_id", "m")
    dots = a.join(b, "g").groupBy("query_id", "id").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    near = dots.join(a_size, "id").join(b_size, "query_id").select("query_id", "id", (F.col("dot") / (F.col("n_size") * F.col("m_size"))).alias("near"))
    asked = queries.select("query_id", words(F.col("text")).alias("w"))
    shared = asked.select("query_id", F.explode("w").alias("word")).join(docs.select("id", F.explode(words(F.col("text"))).alias("word")), "word").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("shared"))
    both = near.join(shared, ["query_id", "id"], "full").join(asked.select("query_id", F.size("w").alias("of")), "query_id")
    return both.select("query_id", "id", (shares[0] * F.coalesce("near", F.lit(0.0)) + shares[1] * F.coalesce(F.col("shared") / F.col("of"), F.lit(0.0))).alias("content"))


def _weighted(rows: DataFrame, key: str, shares: tuple[float, float] | None = None) -> DataFrame:
    """(key, terms, values): counts of three characters at length 1 and words, told apart by their first character; of a query, by their shares of the content."""
    near = shares[0] if shares else 1.0
    grams, size = _counted(rows, key, "n")
    cut = rows.select(key, words(F.col("text")).alias("w")).withColumn("x", F.lit(shares[1]) / F.size("w") if shares else F.lit(1.0))
    each = grams.join(size, key).select(key, F.concat(F.lit("g"), "g").alias("t"), (near * F.col("n") / F.col("n_size")).alias("x"))
    return sparse.rows_of(each.unionByName(cut.select(key, "x", F.explode("w").alias("w")).select(key, F.concat(F.lit("w"), "w").alias("t"), "x")), key, "t", "x")


def local_search(messages: DataFrame, queries: DataFrame, k: int = HITS) -> DataFrame:
    """(query_id, id, score, rank): the best messages (id, text, ts). Recency only weighs what matches by content, which is content()."""
    newest = messages.agg(F.max("ts").alias("newest"))
    fresh = recency((F.col("newest") - F.col("ts")) / 86400.0)
    factor = messages.crossJoin(F.broadcast(newest)).select("id", (1 - RECENT + RECENT * F.coalesce(fresh, F.lit(0.0))).alias("factor"))
    records = stored(_weighted(messages, "id").join(factor, "id"), "weighted")
    return sparse.best(records, stored(_weighted(queries, "query_id", MESSAGE), "asked"), k, least=FLOOR)


def decisions_found(decisions: DataFrame, queries: DataFrame, k: int = DECISIONS) -> DataFrame:
    """(query_id, id, score, rank): decisions (id, text) that a query is about."""
    records = stored(_weighted(decisions, "id").withColumn("factor", F.lit(1.0)), "weighted")
    return sparse.best(records, stored(_weighted(queries, "query_id", DECISION), "asked"), k, least=FLOOR, beyond=True)


def answer(decisions: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, kind, id, place, step): decisions found, each with all that superseded it, and then the best hits.

    decisions(id, text, superseded_by), hits(query_id, id, rank) that passed the gate.
    """
    found = decisions_found(decisions, queries).select("query_id", F.col("id").alias("start"), F.col("rank").alias("place"))
    steps = found.join(chains(decisions.select("id", "superseded_by")), "start").select("query_id", F.lit("decision").alias("kind"), "id", F.col("place").cast("bigint").alias("place"), "step")
    rest = hits.where(F.col("rank") <= ANSWERED).select("query_id", F.lit("message").alias("kind"), "id", F.col("rank").cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("step"))
    return steps.unionByName(rest)
