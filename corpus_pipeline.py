"""A corpus pipeline: reject documents of low quality, drop recurring lines, keep one of each group of near-duplicates, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run()
writes what a stage returns as Parquet in the shared folder and reads it again for the next one, so a lost executor
costs no more than the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import linededup, packing, quality, simhash
from colloquy.llm.common import spread, stored, table

#: The last stage's vocabulary, and the ids of a sequence.
VOCABULARY, CAPACITY = "byte_bpe_50k.json", 2048
#: Near-duplicates by distinct runs of five words: 512 bits, of which Jaccard similarity 0.8 makes 78 differ, give or take
#: 8, name candidates, four deviations wide; the similarity itself is then computed.
NEAR = {"shingle": 5, "words": 8, "radius": 112, "deal": "minima", "bands": 8, "alike": 0.8}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least quality.KEEP. Without any label all are kept."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    if weights is None:
        return docs
    return quality.scored(docs, weights, "__score").where(F.col("__score") >= quality.KEEP).drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates. No document goes; copies are left whole for the next stage."""
    return linededup.without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id."""
    return simhash.one_of_each(docs, **NEAR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences of all documents left, best fit first."""
    return packing.packed(docs, public_tokenizers.path(VOCABULARY), CAPACITY, end_id=0)


STAGES = [("quality_filter", quality_filter), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pack", pack)]

#: The classifier and the tokenizer have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, over the whole documents table."""
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
