"""Messages to items without a model: by the ticket they name, by their thread, or by the item whose words they share most."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cues
from ..functions.text import TICKET, first_cue, trigrams
from .items import STALE_DAYS, UNNAMED, headlines

#: The likeness from which a message joins an item, and the characters from which it begins one.
ALIKE, LONG = 0.12, 60


class _Open:
    """Items so far, with an index from runs of characters to the items that have them."""

    def __init__(self):
        self.keys: list[str] = []
        self.of: dict[str, int] = {}
        self.sizes: list[int] = []
        self.having: dict[str, set[int]] = {}
        self.named = 0

    def item(self, key: str | None = None) -> int:
        if key is None:
            self.named += 1
            key = f"{UNNAMED}-{self.named}"
        if key not in self.of:
            self.of[key] = len(self.keys)
            self.keys.append(key)
            self.sizes.append(0)
        return self.of[key]

    def add(self, item: int, grams: set[str]) -> None:
        for g in grams:
            having = self.having.setdefault(g, set())
            self.sizes[item] += item not in having
            having.add(item)

    def nearest(self, grams: set[str]) -> int | None:
        shared = Counter(i for g in grams for i in self.having.get(g, ()))
        alike = {i: n / (len(grams) + self.sizes[i] - n) for i, n in shared.items()}
        best = max(alike, key=lambda i: (alike[i], -i), default=None)
        return best if best is not None and alike[best] >= ALIKE else None


def assigned(messages: DataFrame) -> DataFrame:
    """(id, channel, item, tier): each message's item; null where nothing claims it and it is too short to begin one.

    messages(id, channel, pos, ts, thread_ts, text). Each message is judged by what came before it in its channel, so a
    channel is a fold, and one task's work: the runs of characters are made by Spark, the fold only counts them. Items
    of a channel that no ticket names are numbered.
    """
    ready = messages.select("id", "channel", "pos", "ts", "thread_ts", F.nullif(F.regexp_extract("text", TICKET, 0), F.lit("")).alias("ticket"), F.length("text").alias("length"), F.array_distinct(trigrams(F.col("text"))).alias("grams"))
    kind = messages.schema["channel"].dataType.simpleString()

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        open_, threads, out = _Open(), {}, []
        for row in rows.sort_values("pos").itertuples():
            grams, thread = set(row.grams), row.thread_ts or None
            tier, item = None, None
            if row.ticket:
                tier, item = "explicit", open_.item(row.ticket)
            elif thread in threads:
                tier, item = "thread", threads[thread]
            elif (near := open_.nearest(grams)) is not None:
                tier, item = "alike", near
            elif row.length > LONG:
                tier, item = "new", open_.item()
            if item is not None:
                open_.add(item, grams)
                if tier in ("explicit", "new") or (tier == "alike" and not thread):
                    threads[thread or row.ts] = item
            out.append((row.id, row.channel, None if item is None else open_.keys[item], tier))
        return pd.DataFrame(out, columns=["id", "channel", "item", "tier"])

    return ready.groupBy("channel").applyInPandas(fold, f"id string, channel {kind}, item string, tier string")


def states(members: DataFrame, stale: float = STALE_DAYS) -> DataFrame:
    """(item, state, evidence_id): by the latest message with a word of completion or of waiting; stalled after some days without any message.

    members(item, id, pos, ts, text). Days count to the newest message of all.
    """
    done, waits = (first_cue(F.col("text"), cues.RELATIONS[k][2]) for k in ("resolves", "blocked_by"))
    said = members.withColumn("says", F.when(done.isNotNull(), "done").when(waits.isNotNull(), "blocked"))
    settles = F.when(F.col("says").isNotNull(), F.struct("pos", "says", "id"))
    g = said.groupBy("item").agg(F.max(settles).alias("s"), F.max("ts").alias("last"), F.max_by("id", "pos").alias("newest"))
    now = members.agg(F.max("ts").alias("now"))
    quiet = (F.col("now") - F.col("last")) / 86400.0 >= stale
    return g.crossJoin(F.broadcast(now)).select("item", F.coalesce("s.says", F.when(quiet, "stalled").otherwise("moving")).alias("state"), F.coalesce("s.id", "newest").alias("evidence_id"))


def built(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (item, headline, state, evidence_id, messages) of all channels, and the messages that belong to none."""
    of = assigned(messages)
    whole = messages.join(of, ["id", "channel"])
    named = F.when(F.col("item").rlike(rf"^{TICKET}$") & ~F.col("item").rlike(rf"^{UNNAMED}-\d+$"), F.col("item")).otherwise(F.concat_ws(":", "channel", "item"))
    members = whole.where("item is not null").withColumn("item", named)
    counts = members.groupBy("item").agg(F.count(F.lit(1)).alias("messages"))
    return headlines(members).join(states(members), "item").join(counts, "item"), whole.where("item is null").select(*messages.columns)
