"""Document fingerprints by winnowing, in DataFrame expressions alone.

Tokens are lower-cased runs between ASCII white space; each character of a script written without spaces is a token of its
own. Each run of K tokens has a hash. The hashes are rolled by doubling: a run's hash is made from those of two shorter
runs, which its neighbours share with it. In each window of W such hashes in a row the least is chosen, the rightmost
of equals; a hash chosen by several windows counts once. Minima are rolled in the same way. So two texts that share
W + K - 1 tokens in a row share a chosen hash, and positions say where.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

K, W = 5, 8
#: Characters that are tokens by themselves.
ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
TOKEN = rf"[^\s{ALONE}]+|[{ALONE}]"
#: Bits of a sort key that hold the position, counted from the end so that the rightmost is least.
PLACE = 30
_ENDS = (1 << PLACE) - 1
#: Stands for a missing doc_id, as the least of all.
NO_ID = -(1 << 63)


def grams(text: Column, k: int = K) -> Column:
    """Hashes of all runs of k tokens; of all tokens, if fewer; none for a text without tokens."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def rolled(h: Column) -> Column:
        n = F.size(h)
        return F.when(n >= k, _rolled(h, k, F.xxhash64)).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, rolled)


def _rolled(values: Column, length: int, both: Callable[[Column, Column], Column], share: bool = False) -> Column:
    """For each run of so many values in a row, both() of two shorter runs that make it up; share: which may overlap."""

    def joined(left: Column, right: Column, shift: int) -> Column:
        n = F.size(right) - shift
        return F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda x, y: both(x, y))  # noqa: PLW0108

    def longer(run: Column, size: int) -> Column:
        if size == length:
            return run
        if 2 * size <= length:
            return _let(joined(run, run, size), lambda twice: longer(twice, 2 * size))
        if share:
            return joined(run, run, length - size)
        return _let(_rolled(values, length - size, both), lambda rest: joined(run, rest, size))

    return longer(values, 1)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<pos: int, hash: bigint>>: the chosen hashes in order of position. Null texts are empty."""

    def chosen(g: Column) -> Column:
        n = F.size(g)
        low = F.lit((1 << (63 - PLACE)) - 1).cast("bigint")
        keys = F.transform(g, lambda h, i: F.shiftleft(h.bitwiseAND(low), PLACE) + (F.lit(_ENDS).cast("bigint") - i))

        def least(keys: Column) -> Column:
            return F.when(n > w, F.array_distinct(_rolled(keys, w, F.least, share=True))).otherwise(F.array(F.array_min(keys)))

        def read(key: Column) -> Column:
            pos = (F.lit(_ENDS) - key.bitwiseAND(F.lit(_ENDS).cast("bigint"))).cast("int")
            return F.struct(pos.alias("pos"), F.get(g, pos).alias("hash"))

        return F.when(n > 0, F.transform(_let(keys, least), read)).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))

    return _let(grams(F.coalesce(text, F.lit("")), k), chosen)


def digest(print_: Column) -> Column:
    """A fingerprint as a short string: equal for equal hashes at equal positions."""
    return F.sha2(F.array_join(F.transform(print_, lambda x: F.concat_ws(":", x["pos"], F.hex(x["hash"]))), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two arrays, from 0 to 1; of two empty fingerprints 1."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def neighbours(docs: DataFrame) -> DataFrame:
    """For each distinct (id, text hash), by ascending id and then hash: n_chars, rows, and the keys before, in a ring.

    docs: (id, th, n). Ids are ranged over tasks; only the ends of the ranges, one row for each, are put in line.
    """
    distinct = docs.groupBy("id", "th").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("times"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(distinct.repartitionByRange(parts, "id", "th").withColumn("range", F.spark_partition_id()))
    key = F.struct("id", "th", "n")
    ends = ranged.groupBy("range").agg(F.max(key).alias("last"))
    line = Window.orderBy("range")
    turn = F.first("last").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = ends.select("range", F.coalesce(F.lag("last").over(line), turn).alias("outer"))
    inner = F.lag(key).over(Window.partitionBy("range").orderBy("id", "th"))
    found = ranged.withColumn("inner", inner).join(F.broadcast(before), "range")
    return found.withColumn("prev", F.coalesce("inner", "outer")).select("id", "th", "n", "times", F.col("prev.id").alias("prev_id"), F.col("prev.th").alias("prev_th"), F.col("prev.n").alias("prev_n"))


def with_edited(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Each row's doc_id, n_chars, edited text, digest and hashes of its own fingerprint, the edited text's fingerprint, and the next document's digest and hashes.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document, by ascending doc_id; after the last comes the first, and a document alone is its own next. A missing
    doc_id comes first; of rows with one doc_id the order is by text hash, and rows that repeat both are one document,
    but all are returned. Null texts are empty. Other columns are not read.

    A text's own fingerprint is made once, before rows are shuffled; its digest and hashes go on with the text, to the
    row itself and to the one before. Both take the same columns, so that Spark makes and shuffles them once.
    """
    mine = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    order = durable(neighbours(mine.select("id", "th", F.length("text").cast("bigint").alias("n"))))
    printed = mine.withColumn("own", fingerprint(F.col("text"), k, w))
    printed = printed.select("id", "th", "text", F.unhex(digest(F.col("own"))).alias("own_digest"), _hashes(F.col("own")).alias("own_hashes"))
    both = printed.join(order.hint("shuffle_merge"), ["id", "th"])
    kept = both.select("id", "th", "n", F.left("text", F.expr("cast(n - n div 2 as int)")).alias("begin"), "own_digest", "own_hashes")
    heads = both.select(F.col("prev_id").alias("id"), F.col("prev_th").alias("th"), F.left("text", F.expr("cast(prev_n div 2 as int)")).alias("head"), F.col("own_hashes").alias("next_hashes"), F.col("own_digest").alias("next_digest"))
    if order.where("times > 1").limit(1).count():
        heads = heads.dropDuplicates(["id", "th"])
    joined = kept.join(heads, ["id", "th"]).withColumn("edited", F.concat("begin", "head"))
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return joined.select(doc_id, F.col("n").alias("n_chars"), "edited", "own_digest", "own_hashes", fingerprint(F.col("edited"), k, w).alias("edited_print"), "next_hashes", "next_digest")


def fingerprints(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, pos, hash): a row for each chosen hash of each text, pos the number of the run's first token from 0.

    Two texts that have W + K - 1 tokens in a row in common have a hash in common, and the positions say where. Null and
    empty texts have none; rows that repeat, or have no doc_id, are treated like others. Other columns are not read.
    """
    return docs.select("doc_id", F.explode(fingerprint(F.col("text"), k, w)).alias("x")).select("doc_id", "x.pos", "x.hash")


def _hashes(print_: Column) -> Column:
    return F.array_distinct(F.transform(print_, lambda x: x["hash"]))


def compared(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    made = with_edited(docs)
    own, changed = F.col("own_hashes"), _hashes(F.col("edited_print"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.hex("own_digest")).alias("fingerprint"),
        digest(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        F.when(F.col("own_digest") == F.col("next_digest"), 1.0).otherwise(likeness(own, F.col("next_hashes"))).alias("near_next"),
    )
