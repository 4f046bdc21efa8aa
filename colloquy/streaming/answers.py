"""A day's answers as keyed state that the day's end ends: a thread's reply wins, and a direct answer stands only without one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where an answer comes from, the one that wins, and those that survive without it.
THREAD, KEPT = "thread", ("dm", "simulated")
#: Microseconds of a day.
DAY = 86_400_000_000


def day_answers(replies: DataFrame, late: str = "1 hour", grace_ms: int = 0) -> DataFrame:
    """(date, user, id, text, kept) of a stream of (date, user, via, at, id, text), each person's answer once the day has ended.

    The last reply in the thread wins; without one the last answer by another way of KEPT stands, and ``kept`` says so.
    Rows with another way, or without a date, user or time, take no part. A day ends when the watermark has passed its
    midnight and ``grace_ms``; what comes for it afterwards is dropped, and its state is gone by then. State is a row for
    each person and day, an aggregate's, so that no day is one task's work and none of it goes through Python. The
    watermark is that of ``at``, and its mark is put on the day's end, by which Spark then ends groups.
    """
    known = replies.where(F.col("via").isin(THREAD, *KEPT)).dropna(subset=["date", "user", "at"]).withWatermark("at", late)
    end = F.timestamp_micros((F.unix_date("date").cast("bigint") + 1) * DAY + (grace_ms + 1) * 1000)  # a group ends at its time, a day after it
    said = F.struct((F.col("via") == THREAD).alias("thread"), F.unix_micros("at").alias("us"), F.coalesce(F.col("id").cast("bigint"), F.lit(-1)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    ready = known.select("date", "user", end.alias("end", metadata=known.schema["at"].metadata), said.alias("said"))
    last = ready.groupBy("date", "user", "end").agg(F.max("said").alias("last"))
    return last.select("date", "user", F.col("last.id").alias("id"), F.col("last.text").alias("text"), (~F.col("last.thread")).alias("kept"))
