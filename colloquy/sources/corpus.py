"""A corpus file of prepared records, checked before anything reads it."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CorpusError(Exception):
    """What is wrong with a corpus file, in words for its owner."""


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(pos, record: variant): the records of a JSON list. Anything else is a CorpusError that names the first bad place."""
    try:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
        found = whole.select(F.try_variant_get("v", "$", "array<variant>").alias("rows"))
        if found.where("rows is null").count() or not found.count():
            raise CorpusError(f"{path} should contain a list of records.")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise CorpusError(f"{path} is not there.") from e
        raise
    rows = found.select(F.posexplode("rows").alias("pos", "record"))
    has = lambda name: F.try_variant_get("record", f"$.{name}", "variant").isNotNull()
    bad = rows.where(~(has("id") & has("text"))).agg(F.min("pos")).first()[0]
    if bad is not None:
        raise CorpusError(f"{path}: record {bad} is not an object with 'id' and 'text'.")
    return rows


def checked(records: DataFrame) -> DataFrame:
    """Records of a table; one without an id or text is an error when it is read."""
    good = F.col("id").isNotNull() & F.col("text").isNotNull()
    return records.withColumn("id", F.when(good, F.col("id")).otherwise(F.raise_error(F.lit("a record needs id and text")).cast(records.schema["id"].dataType)))


def or_exit(load: Callable[[], DataFrame]) -> DataFrame:
    """For programs: a CorpusError is printed, and ends the program."""
    try:
        return load()
    except CorpusError as e:
        sys.exit(str(e))
