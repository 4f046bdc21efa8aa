"""How filters interact: what each of them takes away, alone, in any order and on average over all orders.

Each document has a mask, a bit for each filter that it fails. Per part, documents are counted by mask, and a
subset-zeta transform, one step for each filter, turns these counts into the survivors of every subset of the filters:
those whose mask has no bit of it. What a step of an order takes away is the difference of two neighbouring subsets, so
no order is ever applied to documents. Documents that labels mark are counted in the same way.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, stored
from .winnowing import _let as let

#: What separates words, and what a clean text is without.
SPACES, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
#: The five filters: few words, few different words, capitals, symbols, a copy of an earlier text.
NAMES = "ABCDE"
_STEPS = "array<struct<filter_order: string, step: int, before: int, bit: int, filter: int>>"


def failed(text: Column) -> Column:
    """The mask of the filters that look at one text alone."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def bits(w: Column) -> Column:
        a = F.size(w) < LEAST_WORDS
        b = 100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w)
        return F.when(a, 1).otherwise(0) + F.when(b, 2).otherwise(0)

    c = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)
    d = text.rlike(SYMBOLS)
    return let(words, bits) + F.when(c, 4).otherwise(0) + F.when(d, 8).otherwise(0)


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic), a row for each document: its language, the filters it fails, its labels.

    Null texts are empty, a null language is ''. A copy is a text that a smaller doc_id has, whatever becomes of that;
    rows without a doc_id come after all others, and are no copies of each other. A document is good or toxic if any
    of its labels says so. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    # texts are read once; what goes on is a digest and a few numbers
    marked = stored(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failed(text).alias("mask")), "marked")
    first = durable(marked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    both = marked.join(first.hint("shuffle_merge"), "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))
    both = both.join(durable(said).hint("shuffle_merge"), "doc_id", "left")
    return both.select("doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def survivors(counts: Column, filters: int) -> Column:
    """Subset-zeta: array of counts by mask -> array, at each subset of the filters, of those that fail none of it."""

    def steps(z: Column, k: int) -> Column:
        if k == filters:
            return F.reverse(z)  # at a subset now stands what is within its complement
        bit = 1 << k
        return let(F.transform(z, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(z, i - bit)).otherwise(0)), lambda y: steps(y, k + 1))

    return let(counts, lambda z: steps(z, 0))


def interactions(masks: DataFrame, names: Sequence[str] = NAMES, measures: Sequence[str] = ("good", "toxic")) -> DataFrame:
    """masks(part, mask, measures) -> a row for each part, order of all filters and step.

    (part, filter_order, step, kept, removed, redundant, unique_fails, <measure>_lost.., shapley), as counts of
    documents; measures are 0 or 1 for each. Parts are those that occur; all their orders and steps are returned.
    """
    n, whole = len(names), (1 << len(names)) - 1
    by_mask = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("documents"), *[F.sum(F.col(m).cast("bigint")).alias(m) for m in measures])
    all_ = ["documents", *measures]
    by_part = by_mask.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", m))).alias(m) for m in all_])  # a map has an entry for each mask at most
    at_mask = lambda m: F.transform(F.sequence(F.lit(0), F.lit(whole)), lambda i: F.coalesce(F.try_element_at(F.col(m), i), F.lit(0).cast("bigint")))
    left = by_part.select("part", *[survivors(at_mask(m), n).alias(m) for m in all_])

    def average(k: int) -> Column:
        """What filter k takes away, summed over all orders."""
        out = F.lit(0).cast("bigint")
        for before in range(whole + 1):
            if not before >> k & 1:
                size = before.bit_count()
                out += (F.get("documents", F.lit(before)) - F.get("documents", F.lit(before | 1 << k))) * (factorial(size) * factorial(n - 1 - size))
        return out

    steps = []
    for order in permutations(range(n)):
        before = 0
        for i, k in enumerate(order):
            steps.append({"filter_order": "".join(names[j] for j in order), "step": i + 1, "before": before, "bit": 1 << k, "filter": k})
            before |= 1 << k
    rows = left.withColumn("shapleys", F.array(*[average(k) for k in range(n)])).select("*", F.explode(F.from_json(F.lit(json.dumps(steps)), _STEPS)).alias("s"))
    bit = F.col("s.bit")
    gone = lambda m: F.get(m, F.col("s.before")) - F.get(m, F.col("s.before") + bit)
    removed = gone("documents")
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        F.get("documents", F.col("s.before") + bit).alias("kept"),
        removed.alias("removed"),
        (F.get("documents", F.lit(0)) - F.get("documents", bit) - removed).alias("redundant"),
        (F.get("documents", F.lit(whole) - bit) - F.get("documents", F.lit(whole))).alias("unique_fails"),
        *[gone(m).alias(f"{m}_lost") for m in measures],
        F.get("shapleys", F.col("s.filter")).alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents, per language. An empty table has no parts, and gives an empty result."""
    return interactions(masked(docs, labels))
