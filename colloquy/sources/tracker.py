"""Tickets: the tracker's rows, searches over them, and channels' projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import embed_text

#: The tracker's row; a state is the field whose value's type says so, whatever the field is called.
ROW = "idReadable string, summary string, description string, resolved bigint, updated bigint, created bigint, customFields array<struct<name:string, value:struct<name:string, type:string>>>"
STATE_TYPE = "StateBundleElement"


def tickets(rows: DataFrame, base: str = "") -> DataFrame:
    """Rows of ROW -> (ticket, title, text, state, resolved, updated, created, url); the first of each key stays."""
    state = F.get(F.filter("customFields", lambda x: x["value"]["type"].endswith(STATE_TYPE)), F.lit(0))
    out = rows.select(
        F.upper("idReadable").alias("ticket"),
        F.coalesce("summary", F.lit("")).alias("title"),
        embed_text(F.coalesce("summary", F.lit("")), F.col("description")).alias("text"),
        F.coalesce(state["value"]["name"], F.lit("")).alias("state"),
        F.col("resolved").isNotNull().alias("resolved"),
        (F.coalesce("updated", F.lit(0)) / 1000.0).alias("updated"),
        (F.coalesce("created", F.lit(0)) / 1000.0).alias("created"),
        F.concat(F.lit(base.rstrip("/") + "/issue/"), "idReadable").alias("url"),
    )
    return out.dropDuplicates(["ticket"])


#: Fixed value: characters below which a ticket's text says nothing that clustering could use.
LEAST_TEXT = 12


def telling(records: DataFrame) -> DataFrame:
    """Records of tickets whose text, without space at its ends, is long enough to be compared with others."""
    return records.where(F.length(F.trim("text")) >= LEAST_TEXT)


def as_records(found: DataFrame) -> DataFrame:
    """Tickets as records, which are their own ticket."""
    return found.select(F.concat(F.lit("yt_"), "ticket").alias("id"), F.col("updated").alias("ts"), "text", F.lit("youtrack").alias("source"), F.col("ticket").alias("youtrack_key"), F.col("state").alias("youtrack_state"), F.col("url").alias("youtrack_url"), F.col("resolved").alias("youtrack_resolved"))


def by_keys(found: DataFrame, keys: DataFrame) -> DataFrame:
    """Tickets of the given keys (key), whatever their case; keys the tracker doesn't know are simply not there."""
    return found.join(keys.select(F.upper("key").alias("ticket")).distinct(), "ticket", "left_semi")


def searched(found: DataFrame, text: str, projects: list[str] | None = None, limit: int = 50) -> DataFrame:
    """A key, a number within the projects, or words of the title; the newest first."""
    wanted = text.strip()
    own = F.substring_index("ticket", "-", 1)
    hit: Column
    if wanted.replace("-", "").isalnum() and "-" in wanted and wanted.rsplit("-", 1)[-1].isdigit():
        hit = F.col("ticket") == wanted.upper()
    elif wanted.isdigit():
        hit = F.substring_index("ticket", "-", -1) == wanted
    else:
        hit = F.lower("title").contains(wanted.lower())
    out = found.where(hit)
    if projects:
        out = out.where(own.isin([p.upper() for p in projects]))
    return out.orderBy(F.desc("updated"), "ticket").limit(limit)


def channel_projects(spark: SparkSession, raw: str) -> DataFrame:
    """"PROJ (Label)=C1,C2; ..." -> (channel_id, project, label, pos); groups that don't parse are skipped."""
    groups = spark.createDataFrame([(raw,)], "raw string").select(F.posexplode(F.split("raw", ";")).alias("pos", "g"))
    shape = r"^\s*([A-Za-z][A-Za-z0-9_]*)\s*(?:\(([^)]*)\))?\s*=\s*(.+?)\s*$"
    good = groups.where(F.col("g").rlike(shape)).select("pos", F.upper(F.regexp_extract("g", shape, 1)).alias("project"), F.trim(F.regexp_extract("g", shape, 2)).alias("label"), F.explode(F.split(F.regexp_extract("g", shape, 3), ",")).alias("channel_id"))
    clean = good.withColumn("channel_id", F.trim("channel_id")).where("channel_id != ''")
    return clean.select("channel_id", "project", F.when(F.col("label") == "", F.col("project")).otherwise(F.col("label")).alias("label"), "pos")


def all_projects(projects: list[DataFrame]) -> DataFrame:
    """Tickets of several projects, in the order of the projects; of those with one key the first stays."""
    out = None
    for k, part in enumerate(projects):
        part = part.withColumn("__place", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = Window.partitionBy("ticket").orderBy("__place")
    return out.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth", "__place")
