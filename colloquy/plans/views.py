"""Queries behind pages and cards: counts, orders, placements, forms. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import when
from ..functions import text as T
from ..operators import decisions, drift, relations, signals, state, upserts
from ..sources import tracker
from ..sources.tables import conversation_records, table
from .search import RECORDS
from .work import _EXPLICIT, _LINES, _MESSAGES, _STATE, _TICKETS, NOW, _declared, _events, _messages, _states, _steps, _tickets


def trusted_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Prefixes of keys in messages of several kinds; standards and lone short ones are no tickets."""
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("ORD-"), F.col("o_custkey").cast("string"))).when(F.col("o_orderkey") % 4 == 1, "UTF-8 and RFC-822").when(F.col("o_orderkey") % 4 == 2, "QQ-1 only").otherwise(F.concat(F.lit("AB-"), F.pmod("o_custkey", F.lit(9)).cast("string")))
    return relations.trusted_prefixes(table(spark, d, "orders").select(text.alias("text")))


def ticket_counts(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    named = m.select("id", F.explode(T.ticket_keys(F.col("text"))).alias("ticket")).join(relations.trusted_prefixes(m), T.prefix(F.col("ticket")) == F.col("prefix"), "left_semi")
    return named.groupBy("ticket").agg(F.count(F.lit(1)).alias("n"))


def placement_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many messages each item has; the ten largest."""
    placed = relations.link(_messages(spark, d)).where("key != ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), "key")
    return placed.withColumn("place", F.row_number().over(order).cast("bigint")).where("place <= 10")


def unassigned(spark: SparkSession, d: str) -> DataFrame:
    """Messages that no tier places; they are shown, never dropped."""
    return relations.link(_messages(spark, d)).where("key = ''").select("id")


def channel_projects(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' channels as projects, written as one line of configuration."""
    line = "ASIA (Asia)=S0,S1; EU=S2; bad group; US (United States)=S3"
    p = tracker.channel_projects(spark, line).select("channel_id", "project", "label")
    return _messages(spark, d).select("channel_id").join(p, "channel_id", "left").groupBy("channel_id", "project", "label").agg(F.count(F.lit(1)).alias("n"))


def item_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items found by exact id, then by folded case, then by number: the best tier of each asked name."""
    asked = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string")).alias("asked"))
    items = table(spark, d, "orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("item"))
    keys = items.select("item", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("item").alias("k")), F.struct(F.lit(1).alias("tier"), F.lower("item").alias("k")), F.struct(F.lit(2).alias("tier"), F.substring_index("item", "-", -1).alias("k")))).alias("x")).select("item", "x.*")
    asked_keys = asked.select("asked", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.col("asked").alias("k")), F.struct(F.lit(1).alias("tier"), F.lower("asked").alias("k")), F.struct(F.lit(2).alias("tier"), F.col("asked").alias("k")))).alias("x")).select("asked", "x.*")
    return asked_keys.join(keys, ["tier", "k"]).groupBy("asked").agg(F.min(F.struct("tier", "item")).alias("b")).select("asked", "b.item", F.col("b.tier").cast("bigint").alias("tier"))


def open_and_silent(spark: SparkSession, d: str) -> DataFrame:
    """Open tickets, marked where they are silent."""
    _, tickets, said = _tickets(spark, d)
    named = drift.mentions(said).select(F.upper("ticket").alias("ticket"))
    now = float(spark.sql(f"select unix_seconds(timestamp'{NOW}') as s").first()["s"])
    quiet = drift.silent(tickets, named, now).select("ticket", F.lit(True).alias("silent"))
    return tickets.where("not resolved").join(quiet, "ticket", "left").select("ticket", F.coalesce("silent", F.lit(False)).alias("silent"))


def messages_by_day(spark: SparkSession, d: str) -> DataFrame:
    """A person's days: how many messages, the newest first, at most forty days."""
    e = _events(spark, d).withColumn("day", F.left(when.shown(F.col("ts")), F.lit(10)))
    days = e.groupBy("user", "day").agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("place", F.row_number().over(Window.partitionBy("user").orderBy(F.desc("day"))).cast("bigint")).where("place <= 40")


def hot_items(spark: SparkSession, d: str) -> DataFrame:
    """Blocked items by age; hot after three days, their age in words."""
    now = F.lit(float(spark.sql(f"select unix_seconds(timestamp'{NOW}') as s").first()["s"]))
    e, said, cleared = _declared(spark, d)
    s = state.with_declarations(state.inferred(_steps(e), e), e.select("id", "topic", "user", "ts"), said, cleared).where("state = 'blocked'").withColumn("age", when.age_days(now, F.col("since")))
    return s.select("topic", (F.col("age") >= 3).alias("hot"), when.human_age(F.col("age")).alias("age"))


def daily_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each day of events: who answered, who of all people is missing, how many blockers."""
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    everyone = e.select("user_id").distinct()
    asked = e.select("date").distinct().join(everyone, F.lit(True))
    said = e.groupBy("date", "user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("b"))
    both = asked.join(said, ["date", "user_id"], "left")
    return both.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("b").alias("answered"), F.count(F.when(F.col("b").isNull(), 1)).alias("missing"), F.coalesce(F.sum("b"), F.lit(0)).alias("blockers"))


def last_reply_wins(spark: SparkSession, d: str) -> DataFrame:
    """Each person's last event of a day; direct answers stay where the thread has none."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("user"), "ts", "event_id", "event_type")
    last = lambda df: df.groupBy("date", "user").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("date", "user", F.col("m.event_id").alias("event_id"))
    merged = drift.thread_over_direct(last(e.where("event_type != 'view'")), last(e.where("event_type = 'view'")))
    return merged.select(F.col("date").cast("string").alias("date"), "user", "event_id")


def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id")).distinct().withColumn("kind", F.lit("old"))
    new = o.where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("id")).distinct().withColumn("kind", F.lit("new"))
    return upserts.insert_absent(old, new)


def meeting_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as meetings; every fourth comes again with only its first line."""
    r = conversation_records(spark, d).select(F.format_string("mtg_%d_%d", "conv_id", "turn").alias("id"), "conv_id", "turn")
    return upserts.upsert_meeting(r.select("id"), r.where("conv_id % 4 = 0 and turn = 0").select("id"))


def resume_point(spark: SparkSession, d: str) -> DataFrame:
    """The newest time of a channel, compared as a number: as text, 9 would come after 10."""
    r = conversation_records(spark, d).withColumn("raw", F.when(F.col("turn") == 1, "not a time").otherwise(F.col("ts").cast("string")))
    return r.groupBy("channel_id").agg(F.max(when.seconds(F.col("raw"))).alias("newest"))


def standup_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms filled in by orders: who declares a blocker, and when it was last cleared."""
    o = table(spark, d, "orders")
    answer = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("waiting for part "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, "None.").otherwise("-")
    r = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user"), F.col("o_orderkey").cast("double").alias("ts"), F.concat(F.lit("What are you working on today?\n- orders\n*Are there any blockers*?\n"), answer).alias("text"))
    slots = state.form_slots(r)
    said = state.declared(slots).groupBy("user").agg(F.count(F.lit(1)).alias("declared"))
    return said.join(state.cleared(slots), "user", "full").select("user", F.coalesce("declared", F.lit(0)).cast("bigint").alias("declared"), F.coalesce("cleared", F.lit(-1.0)).cast("bigint").alias("cleared"))


def superseded_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns of one person as decisions; a later one that is alike enough supersedes."""
    r = conversation_records(spark, d)
    said = r.select("id", F.col("turn").alias("pos"), F.col("ts").alias("at"), F.concat(F.lit("we ship "), F.when(F.col("turn") == 1, "something quite different").otherwise("the build on monday")).alias("text"), F.col("thread_ts").alias("topic"))
    return decisions.superseded(said)


def same_thread_pairs(spark: SparkSession, d: str) -> DataFrame:
    return signals.thread_pairs(conversation_records(spark, d))


def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """What of a document an encoder would read: its source, and its first two lines of prose."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(T.embed_text(F.col("source"), F.col("text"))).cast("bigint").alias("n"))


def shortened(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha1(T.shorten(F.col("text"), 120).cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        trusted_prefixes, ticket_counts, placement_histogram, unassigned, channel_projects, item_lookup, open_and_silent, messages_by_day, hot_items, daily_summary, last_reply_wins,
        insert_if_absent, meeting_upsert, resume_point, standup_forms, superseded_decisions, same_thread_pairs, embed_texts, shortened,
    )
}

ORACLE = {
    "trusted_prefixes": "WITH k AS (SELECT DISTINCT unnest(CASE o_orderkey % 4 WHEN 0 THEN ['ORD-' || o_custkey] WHEN 1 THEN ['UTF-8', 'RFC-822'] WHEN 2 THEN ['QQ-1'] ELSE ['AB-' || (o_custkey % 9)] END) AS key FROM orders), p AS (SELECT split_part(key, '-', 1) AS prefix, count(*) AS n FROM k GROUP BY ALL) SELECT prefix FROM p WHERE (n > 1 OR length(prefix) >= 3) AND prefix NOT IN ('UTF', 'RFC')",
    "ticket_counts": f"WITH {_MESSAGES} SELECT k AS ticket, count(DISTINCT id) AS n FROM (SELECT id, unnest(keys) AS k FROM msg) GROUP BY k",
    "placement_histogram": f"WITH {_EXPLICIT}, p AS (SELECT key, count(*) AS n FROM st WHERE key IS NOT NULL GROUP BY key) SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS place FROM p QUALIFY place <= 10",
    "unassigned": f"WITH {_EXPLICIT} SELECT id FROM st WHERE key IS NULL",
    "channel_projects": f"WITH {_LINES}, p(channel_id, project, label) AS (VALUES ('S0', 'ASIA', 'Asia'), ('S1', 'ASIA', 'Asia'), ('S2', 'EU', 'EU'), ('S3', 'US', 'United States')) SELECT channel_id, project, label, count(*) AS n FROM (SELECT 'S' || (l_suppkey % 5) AS channel_id FROM li) LEFT JOIN p USING (channel_id) GROUP BY ALL",
    "item_lookup": "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'ord-' || o_orderkey WHEN 1 THEN 'ORD-' || o_orderkey ELSE o_orderkey::VARCHAR END AS asked, 'ORD-' || o_orderkey AS item, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END::BIGINT AS tier FROM orders",
    "open_and_silent": f"WITH {_TICKETS} SELECT ticket, updated > 0 AND topic NOT IN (SELECT topic FROM mn) AND (epoch(TIMESTAMP '{NOW}') - updated) / 86400 >= 21 AS silent FROM tk WHERE NOT resolved",
    "messages_by_day": "WITH g AS (SELECT user_id AS \"user\", strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY day DESC) AS place FROM g QUALIFY place <= 40",
    "hot_items": f"WITH {_STATE}, c AS (SELECT topic, max(ts) AS cleared FROM ev WHERE relation = 'resolves' AND id % 3 = 0 GROUP BY topic), l AS (SELECT ev.topic, max(ts) AS at FROM ev LEFT JOIN c USING (topic) WHERE relation = 'blocked_by' AND id % 5 = 0 AND (cleared IS NULL OR cleared <= ts) GROUP BY ev.topic), a AS (SELECT topic, (epoch(TIMESTAMP '{NOW}') - coalesce(l.at, since)) / 86400 AS age FROM f LEFT JOIN l USING (topic) WHERE l.at IS NOT NULL OR state = 'blocked') SELECT topic, age >= 3 AS hot, CASE WHEN age * 24 < 1 THEN 'just now' WHEN age * 24 < 24 THEN floor(age * 24)::INT || 'h' WHEN age < 14 THEN floor(age)::INT || 'd' ELSE floor(age / 7)::INT || 'w' END AS age FROM a",
    "daily_summary": "WITH e AS (SELECT ts::DATE AS date, user_id, event_type FROM events), a AS (SELECT d.date, u.user_id FROM (SELECT DISTINCT date FROM e) d CROSS JOIN (SELECT DISTINCT user_id FROM e) u), s AS (SELECT date, user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS b FROM e GROUP BY ALL) SELECT a.date::VARCHAR AS date, count(b) AS answered, count(*) - count(b) AS missing, coalesce(sum(b), 0)::BIGINT AS blockers FROM a LEFT JOIN s USING (date, user_id) GROUP BY a.date",
    "last_reply_wins": "WITH e AS (SELECT ts::DATE AS date, user_id AS \"user\", event_type = 'view' AS v, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL) SELECT date::VARCHAR AS date, \"user\", event_id FROM e QUALIFY row_number() OVER (PARTITION BY date, \"user\" ORDER BY v) = 1",
    "insert_if_absent": "WITH o AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderkey % 5 = 0) SELECT id, 'old' AS kind FROM o UNION ALL SELECT id, 'new' FROM n WHERE id NOT IN (SELECT id FROM o)",
    "meeting_upsert": "SELECT 'mtg_' || conv_id || '_' || turn AS id FROM conversations WHERE conv_id % 4 <> 0 OR turn = 0",
    "resume_point": f"WITH {RECORDS} SELECT channel_id, max(ts)::DOUBLE AS newest FROM rec WHERE turn <> 1 GROUP BY channel_id",
    "standup_forms": "SELECT o_custkey AS \"user\", count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS declared, coalesce(max(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END), -1) AS cleared FROM orders GROUP BY o_custkey",
    "superseded_decisions": f"WITH {RECORDS} SELECT a.id, arg_min(b.id, b.turn) AS superseded_by FROM rec a JOIN rec b ON a.thread_ts = b.thread_ts AND a.turn <> 1 AND b.turn <> 1 AND b.turn > a.turn GROUP BY a.id",
    "same_thread_pairs": f"WITH {RECORDS} SELECT a.id AS l, b.id AS r FROM rec a JOIN rec b ON a.thread_ts = b.thread_ts AND a.id < b.id",
    "embed_texts": r"WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 15 AND NOT regexp_matches(x, '^[#>|!`\[\-*]')) AS p FROM documents), w AS (SELECT doc_id, array_to_string(list_concat([source], p[1:2]), ' ') AS t FROM l) SELECT doc_id, CASE WHEN length(t) > 400 THEN 401 ELSE length(t) END AS n FROM w",
    "shortened": r"WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, sha1(CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END) AS digest FROM t",
}
