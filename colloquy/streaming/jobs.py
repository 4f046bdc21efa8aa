"""Incremental work as Structured Streaming: deduplicated ingest, upserts, and the state of what was announced."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.upserts import Deltas, Versions

#: Groups that keys of streaks are dealt into, and a day before all others.
GROUPS, NEVER = 4096, -(1 << 62)


def deduplicated(stream: DataFrame, key: str = "id", time: str = "ts", late: str = "2 days") -> DataFrame:
    """Rows of a stream, each key once while it may still come again. The boundary of a resumed read repeats rows."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upserting(store: Deltas) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that puts each batch's rows in place of those they repeat; late replies are accepted for ever.

    A batch writes its own rows and no others, so its cost follows the batch and not the store. A batch that is run
    again after a failure writes the same rows in the same place.
    """

    def write(batch: DataFrame, number: int) -> None:
        store.write(batch, number)

    return write


def corrected(store: Deltas, overrides: Versions, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch that links each batch's rows as people have corrected them by then: overrides(id, key), '' unlinks.

    The newest whole snapshot is read anew for each batch, so a correction holds from the next batch on without a
    restart. A snapshot whose pointer is torn, because its writer is not done or was lost, is passed over for the one
    before; without any, rows stay as they came. A batch that is run again takes what is newest then.
    """

    def write(batch: DataFrame, number: int) -> None:
        known = overrides.read()
        if known is not None:
            said = known.groupBy(F.col("id").alias("__id")).agg(F.max("key").alias("__key"))
            both = batch.join(said, batch[key] == F.col("__id"), "left")
            batch = both.withColumn("key", F.when(F.col("__id").isNull(), F.col("key")).otherwise(F.nullif("__key", F.lit("")))).drop("__id", "__key")
        store.write(batch, number)

    return write


def streaks(days: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(user, blocker, date, days, since) for a stream of (day number, date, user, blocker): how long a blocker has come back.

    day numbers count collected days, so only a collected day without the blocker breaks its run. A call and a row of
    state are those of a group of persons and blockers, whose rows are worked on together.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, lasts, counts, sinces = state.get if state.exists else ([], [], [], [])
        rows = pd.concat(list(batches)).sort_values(["key", "day"], kind="stable").drop_duplicates(["key", "day"])
        known = pd.Index(names, dtype=object)
        last = np.array([*lasts, NEVER])[known.get_indexer(rows["key"])]
        rows = rows[rows["day"].to_numpy() > last]
        if rows.empty:
            return
        name, day, date = rows["key"].to_numpy(), rows["day"].to_numpy(), rows["date"].to_numpy()
        place = known.get_indexer(rows["key"])  # -1, the last, for what is new
        head = np.r_[True, name[1:] != name[:-1]]
        before = np.where(head, np.array([*lasts, NEVER])[place], np.r_[NEVER, day[:-1]])
        fresh, at = day != before + 1, np.arange(len(day))
        begin = np.maximum.accumulate(np.where(head | fresh, at, 0))
        count = at - begin + 1 + np.where(fresh[begin], 0, np.array([*counts, 0])[place[begin]])
        since = np.where(fresh[begin], date[begin], np.array([*sinces, ""], dtype=object)[place[begin]])
        held = dict(zip(names, zip(lasts, counts, sinces, strict=True), strict=True))
        end = np.r_[head[1:], True]
        held.update(zip(name[end], zip(day[end].tolist(), count[end].tolist(), since[end], strict=True), strict=True))
        state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        yield pd.DataFrame({"key": name, "date": date, "days": count.astype(np.int32), "since": since})

    kind = days.schema["user"].dataType.simpleString()
    dealt = days.where("day is not null").select(F.pmod(F.xxhash64("user", "blocker"), F.lit(groups)).alias("group"), F.to_json(F.struct("user", "blocker")).alias("key"), F.col("day").cast("bigint").alias("day"), F.col("date").cast("string").alias("date"))
    found = dealt.groupBy("group").applyInPandasWithState(run, "key string, date string, days int, since string", "names array<string>, lasts array<bigint>, counts array<int>, sinces array<string>", "append", GroupStateTimeout.NoTimeout)
    return found.withColumn("k", F.from_json("key", f"user {kind}, blocker string")).select("k.user", "k.blocker", "date", "days", "since")


def announced_once(found: DataFrame) -> DataFrame:
    """Rows of a stream (key, bucket, ...) whose bucket is higher than any before of that key."""

    def first(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = state.get[0] if state.exists else -1
        rows = pd.concat(list(batches)).sort_values("bucket")
        out = []
        for bucket in rows["bucket"]:
            if bucket > told:
                told = int(bucket)
                out.append((*key, told))
        state.update((told,))
        yield pd.DataFrame(out, columns=["key", "bucket"])

    kind = found.schema["key"].dataType.simpleString()
    return found.groupBy("key").applyInPandasWithState(first, f"key {kind}, bucket long", "told long", "append", GroupStateTimeout.NoTimeout)


def last_replies(replies: DataFrame) -> DataFrame:
    """(date, user, at, text): the last reply of each person and day of a stream, for update mode."""
    return replies.groupBy("date", "user").agg(F.max(F.struct("at", "text")).alias("m")).select("date", "user", "m.at", "m.text")


def windowed(events: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
