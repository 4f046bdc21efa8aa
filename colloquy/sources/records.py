"""Records from chat exports: nested threads, roll-ups, runs of one speaker."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import text as T
from ..functions.when import seconds

#: Fixed value: texts of a thread's roll-up.
ROLLED = 21

EXPORT = "ts string, thread_ts string, user string, text string, subtype string, bot_id string, reply_count int, channel_id string, replies array<struct<ts:string, thread_ts:string, user:string, text:string, subtype:string, bot_id:string, channel_id:string>>"


def nested(records: DataFrame) -> DataFrame:
    """Records with thread_ts and turn -> one row for each thread: its parent, and the replies in order."""
    own = F.struct("turn", "id", "ts", "user", "text")
    threads = records.groupBy("thread_ts", "channel_id").agg(F.sort_array(F.collect_list(own)).alias("all"))
    return threads.select("thread_ts", "channel_id", F.get("all", F.lit(0)).alias("parent"), F.slice("all", 2, 1 << 20).alias("replies"))


def flattened(threads: DataFrame) -> DataFrame:
    """Parents and replies, one row each, with their position."""
    return threads.select("thread_ts", "channel_id", F.posexplode(F.concat(F.array("parent"), "replies")).alias("position", "m")).select("thread_ts", "channel_id", "position", "m.*")


def regrouped(rows: DataFrame) -> DataFrame:
    """Flat rows (ts, parent_ts, ...) -> parents with sorted replies; a reply whose parent is missing becomes one itself."""
    own = [c for c in rows.columns if c != "parent_ts"]
    parents = rows.where("parent_ts is null or parent_ts = ts").select(*own)
    replies = rows.where("parent_ts is not null and parent_ts != ts")
    kept = replies.join(parents.select(F.col("ts").alias("parent_ts")).distinct(), "parent_ts", "left_semi")
    orphans = replies.join(parents.select(F.col("ts").alias("parent_ts")).distinct(), "parent_ts", "left_anti").select(*own)
    grouped = kept.groupBy("parent_ts").agg(F.sort_array(F.collect_list(F.struct("ts", *[c for c in own if c != "ts"]))).alias("replies"))
    whole = parents.unionByName(orphans)
    return whole.join(grouped.withColumnRenamed("parent_ts", "ts"), "ts", "left")


def from_export(raw: DataFrame, channel: str) -> DataFrame:
    """An export's threads -> records: useful messages as plain text, the first of each id, and thread roll-ups.

    raw has the columns of EXPORT.
    """
    fields = ["ts", "user", "text", "subtype", "bot_id"]
    parent = F.struct(*fields)
    replies = F.transform(F.coalesce("replies", F.array().cast("array<struct<ts:string, thread_ts:string, user:string, text:string, subtype:string, bot_id:string, channel_id:string>>")), lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    rows = raw.select(F.coalesce("channel_id", F.lit(channel)).alias("channel_id"), F.coalesce("thread_ts", "ts").alias("thread_ts"), F.posexplode(F.concat(F.array(parent), replies)).alias("pos", "m")).select("channel_id", "thread_ts", "pos", "m.*")
    plain = rows.withColumn("mentions", T.mentions(F.coalesce("text", F.lit("")))).withColumn("text", T.normalize(F.coalesce("text", F.lit(""))))
    kept = plain.where(~F.coalesce(F.col("subtype").isin(cues.IGNORED_SUBTYPES), F.lit(False)) & T.is_useful(F.col("text")))
    made = kept.select(
        F.format_string("msg_%s_%s", "channel_id", "ts").alias("id"),
        "channel_id",
        F.col("ts").alias("ts_raw"),
        seconds(F.col("ts")).alias("ts"),
        "thread_ts",
        F.coalesce(F.nullif("user", F.lit("")), "bot_id", F.lit("")).alias("user"),
        "text",
        F.lit("slack").alias("source"),
        "mentions",
        "pos",
    )
    first = Window.partitionBy("id").orderBy("pos")
    return made.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def rollups(records: DataFrame) -> DataFrame:
    """(id, channel_id, thread_ts, text, messages): a thread's first 21 texts as one record, where it has more than one."""
    g = records.groupBy("channel_id", "thread_ts").agg(F.count(F.lit(1)).alias("messages"), F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("all")).where("messages > 1")
    text = F.array_join(F.transform(F.slice("all", 1, ROLLED), lambda x: x["text"]), "\n")
    return g.select(F.concat_ws("_", F.lit("thread"), "channel_id", "thread_ts").alias("id"), "channel_id", "thread_ts", text.alias("text"), F.lit("slack_thread").alias("source"), "messages")


def annotated(records: DataFrame, bots: DataFrame | None = None, own_user: str | None = None) -> DataFrame:
    """Records with analysis_text and is_bot, without the engine's own messages. bots(user)."""
    out = records.withColumn("analysis_text", T.analysis(F.coalesce("text", F.lit(""))))
    if bots is not None:
        out = out.join(bots.select("user").distinct().withColumn("is_bot", F.lit(True)), "user", "left").withColumn("is_bot", F.coalesce("is_bot", F.lit(False)))
    else:
        out = out.withColumn("is_bot", F.lit(False))
    return out.where(F.coalesce(F.col("user") != own_user, F.lit(True))) if own_user else out


def read_corpus(records: DataFrame, include_threads: bool = False, skipped: list[str] | None = None) -> DataFrame:
    """A corpus for analysis: without roll-ups unless asked for, and without skipped channels; a missing channel stays."""
    out = records if include_threads else records.where("source is null or source != 'slack_thread'")
    return out.where(~F.coalesce("channel_id", F.lit("")).isin(skipped)) if skipped else out


def merged_runs(lines: DataFrame, by: str, gap: float, joiner: str = " ") -> DataFrame:
    """(by, user, ts, text, n): lines of one speaker in a row, while they are within ``gap`` seconds of the run's beginning.

    The beginning moves with each run, so this is a fold over a conversation's lines, in pandas. A group is one
    conversation.
    """
    kind = lines.schema[by].dataType.simpleString()

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for row in part.sort_values(["ts", "turn"] if "turn" in part else ["ts"]).itertuples():
            if out and out[-1][1] == row.user and row.ts - out[-1][2] <= gap:
                out[-1][3] += joiner + (row.text or "")
                out[-1][4] += 1
            else:
                out.append([getattr(row, by), row.user, row.ts, row.text or "", 1])
        return pd.DataFrame(out, columns=[by, "user", "ts", "text", "n"])

    return lines.groupBy(by).applyInPandas(fold, f"{by} {kind}, user string, ts double, text string, n int")


def speaker_lines(text: DataFrame, seconds_per_line: float = 20.0) -> DataFrame:
    """Transcripts of "Name: words" lines (path, text) -> (path, pos, offset, user, text); a line without a name goes on for the last speaker."""
    lines = text.select("path", F.posexplode(F.split("text", r"\r\n|[\n\r]")).alias("pos", "line")).where(F.trim("line") != "")
    shape = r"^\s*([^:<>\n]{1,40}?)\s*:\s*((?!//)\S.*)$"
    name = F.nullif(F.trim(F.regexp_extract("line", shape, 1)), F.lit(""))
    w = Window.partitionBy("path").orderBy("pos")
    said = F.when(name.isNotNull(), F.regexp_extract("line", shape, 2)).otherwise(F.col("line"))
    return lines.select("path", "pos", (F.col("pos") * seconds_per_line).alias("offset"), F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit("unknown")).alias("user"), F.trim(said).alias("text"))


def note(text: DataFrame, least: int = 20) -> DataFrame:
    """Notes (title, author, ts, text) as records; shorter ones are dropped."""
    some = text.where(F.length(F.trim("text")) >= least)
    return some.select(F.concat(F.lit("note_"), F.left(F.sha1(F.concat_ws("\n", "title", "text").cast("binary")), F.lit(10))).alias("id"), F.lit(None).cast("string").alias("channel_id"), "ts", F.lit("").alias("thread_ts"), F.col("author").alias("user"), "text", F.lit("note").alias("source"), F.col("title").alias("note_title"))
