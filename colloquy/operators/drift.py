"""Conversation against tracker: disagreements, silence, people, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sparse
from .graphs import stored

#: Hours of quiet after a ticket changed, and days without a word that make a ticket silent.
QUIET_HOURS, SILENT_DAYS = 6.0, 21.0


def mentions(members: DataFrame) -> DataFrame:
    """(topic, ticket, mentions, last_ts, last_id): messages of a topic that name its ticket. members(topic, ticket, id, ts, text, tracker)."""
    some = members.where("not tracker and ts is not null and contains(upper(text), upper(ticket))")
    return some.groupBy("topic", "ticket").agg(F.count(F.lit(1)).alias("mentions"), F.max(F.struct("ts", "id")).alias("l")).select("topic", "ticket", "mentions", F.col("l.ts").alias("last_ts"), F.col("l.id").alias("last_id"))


def detect(topics: DataFrame, tickets: DataFrame, named: DataFrame) -> DataFrame:
    """(topic, ticket, kind): where conversation and ticket disagree; the first kind that fits, and only where people named the ticket.

    topics(topic, ticket, state), tickets(ticket, resolved, updated), named: mentions().
    """
    both = topics.withColumn("k", F.upper("ticket")).join(tickets.select(F.upper("ticket").alias("k"), "resolved", "updated"), "k").join(named.drop("ticket"), "topic")
    talked = (F.col("updated") > 0) & (F.col("last_ts") > F.col("updated") + QUIET_HOURS * 3600)
    kind = F.when(F.col("resolved") & (F.col("state") == "blocked"), "ticket_closed_but_slack_blocked").when(F.col("resolved") & talked, "ticket_closed_but_talking")
    kind = kind.when(~F.col("resolved") & (F.col("state") == "blocked"), "slack_blocked_but_ticket_open").when(~F.col("resolved") & (F.col("state") == "resolved"), "slack_resolved_but_ticket_open")
    return both.withColumn("kind", kind).select("topic", "ticket", "state", "resolved", "mentions", "last_ts", "last_id", "kind")


def agreement(judged: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, verdict): drift, agree, or not comparable where nobody named the ticket."""
    both = topics.select("topic").join(judged.select("topic", "kind", "mentions"), "topic", "left")
    return both.select("topic", F.when(F.coalesce("mentions", F.lit(0)) == 0, "not comparable").when(F.col("kind").isNotNull(), "drift").otherwise("agree").alias("verdict"))


def silent(tickets: DataFrame, named: DataFrame, now: float, days: float = SILENT_DAYS) -> DataFrame:
    """(ticket, idle_days): open tickets that nobody named, unchanged for so long; longest first. named(ticket)."""
    idle = (F.lit(now) - F.col("updated")) / 86400.0
    return tickets.where("not resolved and updated > 0").join(named.select("ticket").distinct(), "ticket", "left_anti").withColumn("idle_days", idle).where(F.col("idle_days") >= days).select("ticket", "idle_days")


def keys_in(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts(text), keys(key) -> (key): the keys that stand anywhere in a text, also within longer words, case aside.

    A key of letters and digits, a hyphen and digits can only stand in a run of that shape: of each run all ends of its first
    part are put together with all beginnings of its second, no longer than the longest keys, and meet the keys as
    equals. Any other key meets the texts that have its first three characters in a row, and is then looked for in full.
    So no text meets a key that it has nothing in common with. Null and empty keys are in no text.
    """
    shape = "^[A-Z0-9]+-[0-9]+$"
    low = stored(keys.select("key", F.upper("key").alias("k")).where("k != ''").distinct(), "keys")
    said = texts.select(F.upper("text").alias("t")).where("t is not null")
    plain, rest = low.where(F.col("k").rlike(shape)), low.where(~F.col("k").rlike(shape))
    cut = F.split("k", "-")
    most = plain.agg(F.coalesce(F.max(F.length(cut[0])), F.lit(0)).alias("a"), F.coalesce(F.max(F.length(cut[1])), F.lit(0)).alias("b")).first()
    run = said.select(F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(r"[A-Z0-9]+(?:-[0-9]+)+"), F.lit(0)))).alias("run")).distinct()
    part = run.select(F.explode(F.expr("transform(sequence(1, size(split(run, '-')) - 1), i -> struct(split(run, '-')[i - 1] as a, split(run, '-')[i] as b))")).alias("p")).select("p.*").distinct()
    ends = part.select(F.explode(F.expr(f"transform(sequence(1, least(length(a), {max(1, most['a'])})), i -> right(a, i))")).alias("a"), "b")
    both = ends.select(F.explode(F.expr(f"transform(sequence(1, least(length(b), {max(1, most['b'])})), i -> concat(a, '-', left(b, i)))")).alias("k"))
    out = plain.join(both.distinct(), "k", "left_semi")
    lengths = [r["n"] for r in rest.select(F.least(F.length("k"), F.lit(3)).alias("n")).distinct().collect()]  # three at most
    if lengths:
        grams = F.concat(*[F.expr(f"transform(sequence(1, greatest(length(t) - {n - 1}, 1)), i -> substr(t, i, {n}))") for n in lengths])
        some = said.distinct().select("t", F.explode(F.array_distinct(grams)).alias("g"))
        first = rest.withColumn("g", F.left("k", F.lit(3)))
        out = out.unionByName(first.join(some, "g").where(F.col("t").contains(F.col("k"))).select("k", "key").distinct())
    return out.select("key").distinct()


def quiet(tickets: DataFrame, texts: DataFrame, now: float, days: float = SILENT_DAYS) -> DataFrame:
    """(ticket, idle_days, mentioned): open tickets unchanged for so long, and whether any text has their key in it."""
    idle = (F.lit(now) - F.col("updated")) / 86400.0
    still = tickets.where("not resolved and updated > 0").withColumn("idle_days", idle).where(F.col("idle_days") >= days).select("ticket", "idle_days")
    named = keys_in(texts, still.select(F.col("ticket").alias("key"))).select(F.col("key").alias("ticket"), F.lit(True).alias("mentioned"))
    return still.join(named, "ticket", "left").select("ticket", "idle_days", F.coalesce("mentioned", F.lit(False)).alias("mentioned"))


def coverage(topics: DataFrame, tickets: DataFrame) -> DataFrame:
    """One row: topics, how many have a ticket, and how many of those the tracker knows."""
    known = tickets.select(F.upper("ticket").alias("k"), F.lit(1).alias("hit"))
    both = topics.withColumn("k", F.upper("ticket")).join(known, "k", "left")
    return both.agg(F.count(F.lit(1)).alias("topics"), F.count("ticket").alias("with_ticket"), F.count("hit").alias("known"))


def people(members: DataFrame) -> DataFrame:
    """(user, items, blocked, messages, last_ts): most blocked first. members(user, topic, state, ts)."""
    return members.groupBy("user").agg(F.countDistinct("topic").alias("items"), F.countDistinct(F.when(F.col("state") == "blocked", F.col("topic"))).alias("blocked"), F.count(F.lit(1)).alias("messages"), F.max("ts").alias("last_ts"))


def partners(members: DataFrame) -> DataFrame:
    """(user, partner, items): people by the items they share."""
    once = members.select("user", "topic").distinct()
    return once.alias("a").join(once.alias("b"), "topic").where("a.user != b.user").groupBy(F.col("a.user").alias("user"), F.col("b.user").alias("partner")).agg(F.count(F.lit(1)).alias("items"))


def best_partners(members: DataFrame, k: int) -> DataFrame:
    """(user, partner, items, rank): the k people with whom someone shares most items, ties to the smaller name; no row for each pair of people.

    People of the same items are a class, named by its first; classes are compared, not people. A class of one of the k + 1 best people has at
    most k classes before it, by items and first name, so the k + 1 best classes and the first k + 1 people of each are enough.
    """
    once = members.where("user is not null and topic is not null").groupBy("user").agg(F.sort_array(F.collect_set("topic")).alias("terms"))
    rows = stored(once, "members")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("terms").orderBy("user"))).where(F.col("place") <= k + 1)
    heads = stored(placed, "heads")
    first = heads.where("place = 1").select(F.col("user").alias("query_id"), "terms", F.transform("terms", lambda _: F.lit(1.0)).alias("values"))
    near = sparse.best(first.select(F.col("query_id").alias("id"), "terms", "values", F.lit(1.0).alias("factor")), first, k + 1).select("query_id", "id", "score")
    named = heads.join(first.select("terms", F.col("query_id").alias("id")), "terms").select("id", F.col("user").alias("partner"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "partner")
    found = stored(near.join(named, "id").withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1), "partners")
    each = rows.join(first.select("terms", "query_id"), "terms").select("user", "query_id").join(found, "query_id").where("user != partner")
    other = each.withColumn("rank", F.row_number().over(Window.partitionBy("user").orderBy("r")))
    return other.where(F.col("rank") <= k).select("user", "partner", F.col("score").cast("bigint").alias("items"), "rank")


# dailies


def streaks(blockers: DataFrame, days: DataFrame) -> DataFrame:
    """(user, blocker, days, since): runs that reach the last collected day.

    blockers(date, user, blocker) in comparable form, days(date) that were collected. Only collected days count, so a
    weekend breaks nothing. A run is where the day's number less the row's number stays the same.
    """
    numbered = days.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy("date")))
    last = numbered.agg(F.max("day").alias("last"))
    once = blockers.where("blocker != ''").select("date", "user", "blocker").distinct().join(numbered, "date")
    run = F.col("day") - F.row_number().over(Window.partitionBy("user", "blocker").orderBy("day"))
    return once.withColumn("run", run).groupBy("user", "blocker", "run").agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("since"), F.max("day").alias("until")).join(F.broadcast(last), F.col("until") == F.col("last")).select("user", "blocker", "days", "since")


def escalations(found: DataFrame, announced: DataFrame, least: int = 3) -> DataFrame:
    """Streaks that are long enough and weren't announced yet. announced(user, blocker)."""
    return found.where(F.col("days") >= least).join(announced.select("user", "blocker").distinct(), ["user", "blocker"], "left_anti")


def thread_over_direct(thread: DataFrame, direct: DataFrame) -> DataFrame:
    """Answers of a thread, and direct ones of people who did not answer there."""
    return thread.unionByName(direct.join(thread.select("date", "user").distinct(), ["date", "user"], "left_anti"))
