"""BM25 over long tables: postings (doc_id, term, tf, dl) and terms (term, df, idf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, terms
from . import sparse
from .graphs import written

#: Saturation, length normalisation, and the idf below which a term explains nothing.
K1, B, EXPLAIN_IDF = 1.5, 0.75, 0.5


def idf(n, df):
    return F.log1p((n - df + 0.5) / (df + 0.5))


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, dl, terms): each document's terms, cut once, and its length, which counts all of them, repeats included."""
    return docs.select(F.col(key).alias("doc_id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("terms")).withColumn("dl", F.size("terms"))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf, dl): one row for each term of a document, and one without a term for the document itself.

    Counts of documents and their mean length follow from the rows without a term, so that texts are cut only once.
    """
    each = counted(docs, text, key).select("doc_id", "dl", F.explode_outer(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    return each.groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_counts(terms_: Column) -> Column:
    """(term, tf) for each different term of an array, found in its sorted form, so that nothing has to be shuffled."""

    def cut(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        told = lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(s))), lambda i, j: F.struct(F.get(s, i).alias("term"), (j - i).cast("bigint").alias("tf")))
        return bound(first, told)

    return F.when(F.size(terms_) > 0, bound(F.sort_array(terms_), cut)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))


def repeated(docs: DataFrame, key: str = "doc_id") -> DataFrame | None:
    """(key) of the ids that several rows have; None, if there are none. Only ids are shuffled."""
    found = written(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__key")))
    return None if found.isEmpty() else found


def term_totals(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(term, df, cf) over documents: how many have a term, and how often it comes in all of them.

    A document is counted within its row, and only sums by term are shuffled. Rows that share an id are one document:
    these are put together first.
    """
    cut = docs.select(F.col(key).alias("doc_id"), terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    twice = repeated(docs, key)
    if twice is not None:
        same = cut["doc_id"].eqNullSafe(twice["__key"])
        whole = cut.join(twice, same, "left_semi").groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        cut = cut.join(twice, same, "left_anti").unionByName(whole)
    return cut.select(F.inline(term_counts(F.col("terms")))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row, from postings: documents, and their mean length in tokens. Empty documents count."""
    return index.where("term is null").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """(query_id, term, qf)."""
    return queries.select(F.col(key).alias("query_id"), F.explode(terms(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def _met(docs: DataFrame, queries: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((doc_id, term, saturated), (query_id, term, idf, share)): of documents and queries what can make a match; a match's weight is share times saturated.

    Documents are cut into terms once and reduced to the queries' terms before anything is shuffled, so the work follows
    the matches and not the corpus; the queries' terms are broadcast while Spark's own size check allows. What is left,
    with a row for each document's length, is written, and everything else is read from it.
    """
    asked = written(query_terms(queries))
    each = counted(docs, text, key).select("doc_id", "dl", F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
    wanted = asked.select("term").union(asked.sparkSession.range(1).select(F.lit(""))).distinct()  # no term is empty: that row is the document's
    index = written(each.join(wanted, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    hit = index.where("term != ''")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = F.broadcast(written(corpus_stats(index.withColumn("term", F.nullif("term", F.lit(""))))))
    known = asked.join(df, "term").crossJoin(stats).withColumn("idf", idf(F.col("n"), F.col("df")))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.crossJoin(stats).select("doc_id", "term", saturated.alias("saturated")), known.select("query_id", "term", "idf", (F.col("idf") * F.col("qf") * (K1 + 1) / (F.col("qf") + K1)).alias("share"))


def matches(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, term, idf, weight) for each query term in a document: a row for each match, so for few queries or few documents."""
    hit, known = _met(docs, queries, text, key)
    return hit.join(known, "term").select("query_id", "doc_id", "term", "idf", (F.col("share") * F.col("saturated")).alias("weight"))


def rows(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Records and queries for operators.sparse, whose products are the scores."""
    hit, known = _met(docs, queries, text, key)
    records = written(sparse.rows_of(hit, "doc_id", "term", "saturated").select(F.col("doc_id").alias("id"), "terms", "values", F.lit(1.0).alias("factor")))
    return records, written(sparse.rows_of(known, "query_id", "term", "share"))


def best(docs: DataFrame, queries: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score, rank): each query's k best above zero, ties to the smaller key; blocks send no more than these."""
    return sparse.best(*rows(docs, queries, text, key), k, least=0.0, beyond=True).withColumnRenamed("id", "doc_id")


def told(docs: DataFrame, queries: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, term, idf) of the k best documents of each query."""
    hit, known = (written(df) for df in _met(docs, queries, text, key))
    records = sparse.rows_of(hit, "doc_id", "term", "saturated").select(F.col("doc_id").alias("id"), "terms", "values", F.lit(1.0).alias("factor"))
    found = sparse.best(records, written(sparse.rows_of(known, "query_id", "term", "share")), k, least=0.0, beyond=True)
    head = written(found.select("query_id", F.col("id").alias("doc_id")))
    return head.join(hit, "doc_id").join(known, ["query_id", "term"]).select("query_id", "doc_id", "term", "idf")


def scores(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "doc_id").agg(F.sum("weight").alias("score"))


def top(scored: DataFrame, k: int, by: str = "query_id", key: str = "doc_id") -> DataFrame:
    """The k best of each query above zero, ties to the smaller key."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("score", 9)), key)
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def matched_terms(found: DataFrame, limit: int = 8, least_idf: float = EXPLAIN_IDF) -> DataFrame:
    """(query_id, doc_id, terms): the terms that explain a match, rarest first."""
    telling = found.where(F.col("idf") >= least_idf).groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("idf", "term")), asc=False).alias("t"))
    return telling.select("query_id", "doc_id", F.transform(F.slice("t", 1, limit), lambda x: x["term"]).alias("terms"))
