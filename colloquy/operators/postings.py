"""A written BM25 index: segments of postings that batches append, block maxima that let a search skip most of them, and merging.

A segment deals its documents into ranges of about ``RANGE_DOCS`` and has these tables, in folders by segment and, where
terms are, by bucket of the term's hash, so that a search reads the buckets of its own terms:

* ``postings`` (term, range, doc_id, tf, dl), in order of term and range;
* ``blocks`` (term, range, n, most_tf, least_dl): a term's postings in a range, and what bounds the weight of each of them
  whatever the mean length has become meanwhile;
* ``docs`` (doc_id, range, dl), ``replaced`` (of, doc_id, range, dl): documents of earlier segments that this one has
  anew; and ``totals`` (docs, tokens), written last: without it a segment doesn't count.

A search first scores the ranges in which the bounds of some query's terms add up to most. A query's k-th best score
found there is a threshold, and only ranges whose bounds reach that of a query are read in the second pass. Results are those of a
search without an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sparse
from .graphs import stored, written
from .lexical import B, K1, counted, idf, query_terms, repeated, term_counts, top

#: Documents of a range, buckets of terms, and ranges of each query in the first pass.
RANGE_DOCS, BUCKETS, FIRST = 256, 64, 4
_SCHEMAS = {
    "postings": "term string, range int, doc_id {key}, tf bigint, dl int",
    "blocks": "term string, range int, n bigint, most_tf bigint, least_dl int",
    "docs": "doc_id {key}, range int, dl int",
    "replaced": "of int, doc_id {key}, range int, dl int",
    "totals": "docs bigint, tokens bigint",
}


#: Rows up to which a table of terms or ranges goes to all tasks; beyond, both sides are shuffled.
SENT = 1 << 18


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, term, range, n, most_tf, least_dl) of what a batch has of each block, of (bucket, term, range, tf, dl)."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["bucket", "term", "range"]).aggregate([("tf", "count"), ("tf", "max"), ("dl", "min")])
        yield from t.select(["bucket", "term", "range", "tf_count", "tf_max", "dl_min"]).rename_columns(["bucket", "term", "range", "n", "most_tf", "least_dl"]).combine_chunks().to_batches()


def _saturated(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class Index:
    """An index in a folder of a shared store. One writer at a time; readers see whole segments only.

    key: the type of doc_id. A document is replaced by a later segment's of the same id; a null id is no document.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "bigint", range_docs: int = RANGE_DOCS) -> None:
        self.spark, self.path, self.key, self.range_docs = spark, path, key, range_docs

    def _table(self, name: str) -> DataFrame | None:
        parts = ", segment int, bucket int" if name in ("postings", "blocks") else ", segment int"
        try:
            return self.spark.read.schema(_SCHEMAS[name].format(key=self.key) + parts).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _whole(self, name: str) -> DataFrame:
        """A table's rows of the segments that count."""
        return self._table(name).where(F.col("segment").isin(self.segments()))

    def segments(self) -> list[int]:
        """Numbers of the whole segments: a few rows, one for each batch since the last merge."""
        found = self._table("totals")
        return sorted(r["segment"] for r in found.select("segment").distinct().collect()) if found is not None else []

    def append(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> int:
        """Write documents as a new segment; of rows with one id the one of greatest text counts. Returns its number.

        Only the batch is cut into terms; of earlier segments the ids are read, to know what the batch replaces.
        """
        known = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        twice = repeated(known)
        if twice is not None:
            same = known["doc_id"] == twice["__key"]
            best = known.join(twice, same, "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
            known = known.join(twice, same, "left_anti").unionByName(best)
        return self._write(stored(counted(known).select(F.col("doc_id").cast(self.key), "dl", term_counts(F.col("terms")).alias("counts")), "cut"))

    def _write(self, cut: DataFrame, merged: bool = False) -> int:
        before = self.segments()
        failed = self._table("docs")
        numbers = [r["segment"] for r in failed.select("segment").distinct().collect()] if failed is not None else []
        n = max([0, *before, *numbers]) + 1
        size = cut.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
        ranges = max(1, -(-size["docs"] // self.range_docs))
        dealt = cut.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
        self._put(dealt.select("doc_id", "range", "dl"), "docs", n)
        if before and not merged:
            old = self.live().withColumnRenamed("segment", "of")
            self._put(old.join(cut.select("doc_id"), "doc_id", "left_semi").select("of", "doc_id", "range", "dl"), "replaced", n)
        else:
            self._put(self.spark.createDataFrame([], _SCHEMAS["replaced"].format(key=self.key)), "replaced", n)
        each = dealt.select("doc_id", "range", "dl", F.inline("counts"))
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        rows = each.withColumn("bucket", bucket).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range")
        self._put(rows.select("term", "range", "doc_id", "tf", "dl", "bucket"), "postings", n, "bucket")
        mine = self._table("postings").where(F.col("segment") == n)
        # postings lie in order, so most of a block's are put together where they are read; dealt by bucket, which is enough for the sums by term and range as well
        part = mine.select("bucket", "term", "range", "tf", "dl").mapInArrow(_folded, "bucket int, term string, range int, n bigint, most_tf bigint, least_dl int")
        blocks = part.repartition("bucket").groupBy("bucket", "term", "range").agg(F.sum("n").alias("n"), F.max("most_tf").alias("most_tf"), F.min("least_dl").alias("least_dl"))
        self._put(blocks.sortWithinPartitions("bucket", "term").select("term", "range", "n", "most_tf", "least_dl", "bucket"), "blocks", n, "bucket")
        self._put(self.spark.createDataFrame([(size["docs"], size["tokens"])], _SCHEMAS["totals"]).coalesce(1), "totals", n)
        return n

    def _put(self, df: DataFrame, name: str, segment: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/segment={segment}")

    def live(self) -> DataFrame:
        """(doc_id, range, dl, segment) of documents that no later segment has replaced."""
        gone = self._whole("replaced").select(F.col("of").alias("segment"), "doc_id")
        return self._whole("docs").join(gone, ["segment", "doc_id"], "left_anti")

    def merge(self, to: str) -> Index:
        """The live documents as one segment of an index in another folder, from postings, without texts."""
        fresh = Index(self.spark, to, self.key, self.range_docs)
        rows = self._whole("postings").join(self.live().select("segment", "doc_id"), ["segment", "doc_id"], "left_semi")
        counts = rows.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("counts"))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        fresh._write(stored(self.live().select("doc_id", "dl").join(counts, "doc_id", "left").select("doc_id", "dl", F.coalesce("counts", none).alias("counts")), "cut"), merged=True)
        return fresh

    def known(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((query_id, term, qf, idf, avgdl, bucket), blocks of these terms): statistics are of live documents."""
        totals, gone = self._whole("totals"), self._whole("replaced")
        lost = gone.agg(F.count(F.lit(1)).alias("lost_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("lost_tokens"))
        stats = totals.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).crossJoin(lost)
        stats = stats.select((F.col("docs") - F.col("lost_docs")).alias("n"), ((F.col("tokens") - F.col("lost_tokens")) / (F.col("docs") - F.col("lost_docs"))).alias("avgdl"))
        asked = written(query_terms(queries).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))
        wanted = asked.select("term", "bucket").distinct()
        blocks = written(self._whole("blocks").join(wanted, ["term", "bucket"], "left_semi"))
        counts = blocks.groupBy("term").agg(F.sum("n").alias("df"))
        # of replaced documents the asked terms' postings are read, in their own ranges
        spots = gone.select(F.col("of").alias("segment"), "range", "doc_id")
        stale = self._whole("postings").join(wanted, ["term", "bucket"], "left_semi").join(spots, ["segment", "range", "doc_id"], "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("stale"))
        df = counts.join(stale, "term", "left").select("term", (F.col("df") - F.coalesce("stale", F.lit(0))).alias("df"))
        told = asked.join(df.where("df > 0"), "term").crossJoin(F.broadcast(stats))
        return written(told.select("query_id", "term", "bucket", "qf", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")), blocks

    def search(self, queries: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """queries(query_id, text) -> (query_id, doc_id, score, rank): the k best above zero, ties to the smaller id."""
        if not self.segments():
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {self.key}, score double, rank int")
        told, blocks = self.known(queries)
        share = F.col("idf") * F.col("qf") * (K1 + 1) / (F.col("qf") + K1)
        wanted = written(told.select("term", "bucket", "avgdl").distinct().withColumn("t", F.monotonically_increasing_id()))
        asked = written(sparse.rows_of(told.join(wanted.select("term", "t"), "term").withColumn("x", share), "query_id", "t", "x"))
        # dealt by range, which is enough for the sums by query and range as well
        near = blocks.repartition("segment", "range").join(_small(told), ["term", "bucket"])
        bounds = written(near.groupBy("query_id", "segment", "range").agg(F.sum(share * _saturated(F.col("most_tf"), F.col("least_dl"), F.col("avgdl"))).alias("bound")))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
        begin = written(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).select("segment", "range").distinct())
        some = written(self._best(wanted, asked, begin, k))
        least = some.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = bounds.join(_small(begin), ["segment", "range"], "left_anti").join(least, "query_id", "left")
        more = self._best(wanted, asked, written(rest.where("least is null or bound >= least - 1e-8").select("segment", "range").distinct()), k)
        return top(some.select("query_id", "doc_id", "score").unionByName(more.select("query_id", "doc_id", "score")), k)

    def _best(self, wanted: DataFrame, asked: DataFrame, where: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, score, rank): each query's k best of the live documents of ranges(segment, range) that any query needs. wanted(term, bucket, avgdl, t), asked(query_id, terms, values), of numbers t.

        Only postings of asked terms in these ranges are shuffled, without their terms' text, and none is multiplied by the queries that
        have its term: a document's are put together, and blocks of documents meet the queries.
        """
        rows = self._whole("postings").join(_small(where), ["segment", "range"], "left_semi").join(_small(wanted), ["term", "bucket"])
        each = rows.select("segment", "doc_id", "t", _saturated(F.col("tf"), F.col("dl"), F.col("avgdl")).alias("x"))
        docs = each.groupBy("segment", "doc_id").agg(F.collect_list(F.struct("t", "x")).alias("p"))
        gone = self._whole("replaced").select(F.col("of").alias("segment"), "doc_id")
        live = docs.join(gone, ["segment", "doc_id"], "left_anti")
        records = written(live.select(F.col("doc_id").alias("id"), F.col("p.t").alias("terms"), F.col("p.x").alias("values"), F.lit(1.0).alias("factor")))
        return sparse.best(records, asked, k, least=0.0, beyond=True).withColumnRenamed("id", "doc_id")
