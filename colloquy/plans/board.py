"""Queries behind the board, the daily reports and recall, over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import when
from ..operators import dailies, drift, evaluation, items, recall, relations
from ..operators.graphs import shared_dir
from ..sources import chat, tracker, transcripts
from ..sources.tables import conversation_records, table
from ..streaming import jobs
from .measures import _ranked
from .search import _COS, RECORDS
from .work import _DAILIES, _LINES, _STATE, NOW, _dailies, _events, _messages, _states

_NOW = f"epoch(TIMESTAMP '{NOW}')"


def _now() -> Column:
    return F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6


# the board


def _topics(spark: SparkSession, d: str) -> DataFrame:
    """People's events as topics: some headlines say their state, and only a change of state has evidence."""
    e = _events(spark, d)
    last = e.groupBy("topic").agg(F.max("ts").alias("last_ts"))
    s = _states(spark, d).join(last, "topic")
    changed = F.col("state") != "active"
    return s.select("topic", F.concat(F.lit("T-"), F.col("topic").cast("string")).alias("item"), F.concat(F.lit("label "), F.col("topic").cast("string")).alias("label"), F.when(F.col("topic") % 3 == 0, F.concat(F.lit("item "), F.col("topic").cast("string"), F.lit(" — in progress"))).when(F.col("topic") % 3 == 1, " — resolved").alias("headline"), "state", F.when(changed, F.concat(F.lit("by event "), F.col("evidence_id").cast("string"))).otherwise("").alias("evidence"), F.when(changed, F.col("evidence_id").cast("string")).otherwise(" ").alias("evidence_id"), ((_now() - F.col("last_ts")) / 86400.0).alias("age_days"), "last_ts")


def _board(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.concat(F.lit("T-"), F.col("topic").cast("string")).alias("item"), F.col("id").cast("string").alias("id"), F.col("id").alias("pos"), "ts", F.concat(F.lit("at "), F.col("id").cast("string")).alias("shown"))
    return items.work_items(_topics(spark, d), e, _now(), 0.5)


def board_items(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d)


_BOARD = f"""{_STATE}, nw AS (SELECT topic, arg_max(id, (ts, -id)) AS nid, max(ts) AS last FROM ev GROUP BY topic),
  bd AS (SELECT 'T-' || f.topic AS item, CASE f.topic % 3 WHEN 0 THEN 'item ' || f.topic WHEN 1 THEN '— resolved' ELSE 'label ' || f.topic END AS headline,
    CASE WHEN state = 'blocked' THEN 'blocked' WHEN state = 'resolved' THEN 'done' WHEN ({_NOW} - last) / 86400 > 0.5 THEN 'stalled' ELSE 'moving' END AS state,
    CASE WHEN state <> 'active' THEN 'by event ' || evidence_id ELSE 'ยังไม่มีสัญญาณเปลี่ยนสถานะ — ล่าสุด at ' || nid END AS evidence, CASE WHEN state <> 'active' THEN evidence_id ELSE nid END::VARCHAR AS evidence_id,
    round(({_NOW} - last) / 86400, 1)::DOUBLE AS age_days, last FROM f JOIN nw USING (topic))"""
_PLACE = "CASE state WHEN 'blocked' THEN 1 WHEN 'stalled' THEN 2 WHEN 'moving' THEN 3 ELSE 4 END"


def board_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The first 47 items of the board, and how many more there are."""
    b = _board(spark, d)
    return items.trimmed(b, [*items.board_order(F.col("state"), F.col("age_days")), F.asc("item")]).select("item", F.col("place").cast("bigint").alias("place"), F.col("omitted").cast("bigint").alias("omitted"))


def board_lists(spark: SparkSession, d: str) -> DataFrame:
    """What each of the four orders begins with, of items that have the letters of a filter."""
    b = items.filtered(_board(spark, d).withColumn("place", items.state_place(F.col("state"))).withColumn("age", F.col("age_days")).withColumn("last", -F.col("age_days")).withColumn("size", F.length("evidence")), " T-1", ["headline", "item", "state"])
    out = None
    for by in ("urgency", "age", "recent", "size"):
        some = b.orderBy(*items.list_order(by), "item").limit(7).select(F.lit(by).alias("sorted_by"), "item")
        out = some if out is None else out.unionByName(some)
    return out


def item_headlines(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return items.headlines(c.select(F.col("conv_id").alias("item"), F.col("turn").alias("pos"), "text"))


def _carded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as topics: every fifth has a ticket, every seventh a written headline, every second begins politely."""
    c = table(spark, d, "conversations")
    key = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("ORD-"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    topics = c.select(F.col("conv_id").alias("topic"), key.alias("item_id"), F.lit("label").alias("label"), F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("written "), F.col("conv_id").cast("string"))).alias("headline")).distinct()
    text = F.when((F.col("turn") == 0) & (F.col("conv_id") % 2 == 0), "ok thanks, that helps a lot").otherwise(F.col("text"))
    ticket = F.when((F.col("turn") == 1) & (F.col("conv_id") % 10 == 0), F.concat(F.lit("ord-"), F.col("conv_id").cast("string")))
    return topics, c.select(F.col("conv_id").alias("topic"), F.col("turn").alias("id"), F.col("turn").cast("double").alias("ts"), F.when(ticket.isNotNull(), "youtrack").otherwise("slack").alias("source"), text.alias("text"), ticket.alias("ticket"))


def card_titles(spark: SparkSession, d: str) -> DataFrame:
    return items.card_titles(*_carded(spark, d))


_CARDS = r"""
WITH r AS (SELECT conv_id AS topic, turn, CASE WHEN turn = 0 AND conv_id % 2 = 0 THEN 'ok thanks, that helps a lot' ELSE text END AS text, turn = 1 AND conv_id % 10 = 0 AS tracker FROM conversations),
  l AS (SELECT topic, turn, text, tracker, CASE WHEN length(t) > 90 THEN substr(t, 1, 89) || '…' ELSE t END AS line FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM r)),
  h AS (SELECT topic, arg_min(line, turn) FILTER (length(line) >= 18 AND line <> 'ok thanks, that helps a lot') AS first, arg_max(line, (length(line), -turn)) AS longest FROM l WHERE NOT tracker GROUP BY topic),
  k AS (SELECT topic, substr(trim(split_part(trim(text), chr(10), 1)), 1, 110) AS title FROM l WHERE tracker)
SELECT t.topic, CASE WHEN t.topic % 7 = 0 THEN 'written ' || t.topic WHEN title IS NOT NULL THEN 'ORD-' || t.topic || ' · ' || title ELSE coalesce(first, longest) END AS title FROM (SELECT DISTINCT conv_id AS topic FROM conversations) t LEFT JOIN h USING (topic) LEFT JOIN k USING (topic)
"""


# what a request means


def items_named(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items, asked for by key, by number, and by a key that is longer than theirs."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("what about ord-"), k, F.lit(" today?"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("see "), k)).otherwise(F.concat(F.lit("not ORD-"), k, F.lit("9, but")))
    return items.items_named(o.select(F.concat(F.lit("ORD-"), k).alias("item")).distinct(), o.select(F.col("o_orderkey").alias("query_id"), text.alias("text")).distinct())


def people_named(spark: SparkSession, d: str) -> DataFrame:
    """Customers by id or by nation's number as a name, which several share."""
    c = table(spark, d, "customer").select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user"), F.concat(F.lit("Name "), F.col("c_nationkey").cast("string")).alias("name"))
    asked = c.select(F.when(F.substring("user", -1, 1) == "0", F.concat(F.lit(" "), F.upper("name"))).otherwise(F.col("user")).alias("asked"))
    return items.people_named(c, asked).select(F.trim("asked").alias("asked"), "user")


def items_of_person(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("item"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("moving").alias("state"), F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("assignee"), F.array(F.concat(F.lit("U"), (F.col("o_custkey") + 1).cast("string")), F.lit(None)).alias("participants"))
    c = table(spark, d, "customer")
    names = c.select(F.concat(F.lit("U"), F.col("c_custkey").cast("string")).alias("user"), F.concat(F.lit("Person "), F.col("c_custkey").cast("string")).alias("name"))
    asked = c.select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("@person "), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string"))).alias("asked"))
    return items.items_of_person(o, names, asked).select(F.regexp_extract("asked", r"(\d+)$", 1).cast("bigint").alias("custkey"), "item")


def _linked(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey").distinct()
    return o.select(F.format_string("m%d_1", "o_orderkey").alias("id"), F.concat(F.lit("ticket:ord-"), F.pmod("o_orderkey", F.lit(60)).cast("string")).alias("key"))


def strays(spark: SparkSession, d: str) -> DataFrame:
    """Messages that people linked to a supplier's ticket and that stand with another supplier."""
    m = _messages(spark, d).select("id", F.col("label").alias("topic"))
    topics = m.select("topic", F.concat(F.lit("ORD-"), F.col("topic").cast("string")).alias("item_id")).distinct()
    return items.strays(_linked(spark, d), m, m, topics)


def hits_placed(spark: SparkSession, d: str) -> DataFrame:
    """Messages as hits, with the topic that each stands in and the key that only a person's link gives it."""
    m = _messages(spark, d)
    members = m.select("id", F.col("label").alias("topic"), F.lit(1).alias("place")).unionByName(m.where("pos % 4 = 0").select("id", (F.col("label") + 100).alias("topic"), F.lit(2).alias("place")))
    links = table(spark, d, "orders").select(F.format_string("m%d_2", "o_orderkey").alias("id"), F.concat(F.lit("ord-"), F.pmod("o_orderkey", F.lit(499)).cast("string")).alias("key")).distinct()
    return items.found_by_link(items.owners(m.select("id", "text"), members), links).select("id", "topic", "linked")


def drifts_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Orders as drifts of items and messages of which some are not there."""
    o = table(spark, d, "orders").select("o_orderkey").distinct()
    drifts = o.select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("item"), F.format_string("m%d_%d", "o_orderkey", F.pmod("o_orderkey", F.lit(9)) + 1).alias("trigger"))
    return items.resolvable(drifts, o.where("o_orderkey % 4 != 0").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("item")), _messages(spark, d)).select("item", "trigger")


def ids_decoded(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey").distinct()
    k = F.col("o_orderkey").cast("string")
    id_ = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("msg_C0AB_"), k, F.lit(".000100"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("mtg_x_"), k)).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("paste_"), k)).otherwise(F.concat(F.lit("msg_c0_"), k))
    given = F.when(F.col("o_orderkey") % 5 == 0, "note").when(F.col("o_orderkey") % 5 == 1, "elsewhere")
    key = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit(" tam-"), k)).when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit("ord-"), k)).when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("cluster:"), k)).when(F.col("o_orderkey") % 6 == 3, " ").otherwise(k)
    user = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("U0"), F.lpad(k, 8, "0"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Umi "), k)).otherwise(F.concat(F.lit("W"), k))
    r = o.select("o_orderkey", id_.alias("id"), given.alias("given"), key.alias("key"), user.alias("user"))
    return r.select("o_orderkey", items.permalink(F.col("id"), "https://w").alias("link"), items.channel_of(F.col("id")).alias("channel"), items.source_of(F.col("id"), F.col("given")).alias("source"), items.linker_key(F.col("key")).alias("linker_key"), items.item_key(F.concat(F.lit("Ticket:"), F.col("key"))).alias("item_key"), items.is_chat_id(F.col("user")).alias("chat_id"))


_IDS = """
WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders),
  r AS (SELECT k, CASE k % 4 WHEN 0 THEN 'C0AB' END AS channel, CASE k % 5 WHEN 0 THEN 'note' ELSE CASE k % 4 WHEN 1 THEN 'meeting' WHEN 2 THEN 'slack_paste' ELSE 'slack' END END AS source,
    CASE k % 6 WHEN 0 THEN ' tam-' || k WHEN 1 THEN 'ord-' || k WHEN 2 THEN 'cluster:' || k WHEN 3 THEN ' ' ELSE k::VARCHAR END AS key FROM o)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 'https://w/archives/C0AB/p' || k || '000100' END AS link, channel, source,
  CASE k % 6 WHEN 0 THEN 'cluster:' || k WHEN 1 THEN CASE WHEN length(k::VARCHAR) <= 6 THEN 'ticket:ORD-' || k END WHEN 2 THEN key WHEN 3 THEN '' END AS linker_key, trim(key) AS item_key,
  k % 3 = 0 OR (k % 3 = 2 AND length(k::VARCHAR) >= 7) AS chat_id FROM r
"""


def blockers_stated(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    evidence = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("blocked since today — “ waiting for "), F.col("doc_id").cast("string"), F.lit(" ” as said"))).otherwise(F.lit('no "abc" here'))
    said = F.concat(F.lit("\n  \nfirst of "), F.col("doc_id").cast("string"), F.lit("  \r\nsecond"))
    r = docs.select("doc_id", items.stated_blocker(evidence, said).alias("blocker"), items.cue_inside(F.concat(F.lit("We AGREED on "), F.coalesce("lang", F.lit(""))), ["final", "agreed on d", "agreed"]).alias("cue"))
    return r


# daily reports


def _reply_lines() -> tuple[Column, Column, Column]:
    k = F.col("o_orderkey").cast("string")
    none = F.array().cast("array<string>")
    done = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.concat(F.lit("closed ORD-"), k), F.lit("- "))).otherwise(F.array(F.concat(F.lit("wrote "), k, F.lit("\nread it again"))))
    focus = F.when(F.col("o_orderkey") % 4 == 0, none).otherwise(F.array(F.concat(F.lit("• next of "), k)))
    blockers = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.concat(F.lit("Pending the key of "), k, F.lit(" <@U1234567|Nok>")), F.lit("Pending PO"))).when(F.col("o_orderkey") % 5 == 1, F.array(F.lit("none"))).otherwise(none)
    return done, focus, blockers


def daily_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies written out under the three headings, and read back."""
    o = table(spark, d, "orders").select("o_orderkey").distinct()
    kind = F.col("o_orderkey") % 7
    text = F.when(kind == 0, "just talk: Pending nothing").when(kind == 1, "*Done Yesterday:*\nFinished ticket #[ID]\nFocus today\n- xxxx").otherwise(F.concat(F.lit("good morning\n"), dailies.composed(*_reply_lines(), empty="-")))
    found = dailies.parsed_replies(o.select(F.col("o_orderkey").alias("id"), text.alias("text")))
    return found.select("id", "kind", F.array_join("done", "|").alias("done"), F.array_join("focus", "|").alias("focus"), F.array_join(F.transform("blockers", lambda b: F.concat(b["text"], F.lit("@"), b["tag"])), "|").alias("blockers"))


_REPLIES = """
SELECT k AS id, CASE k % 7 WHEN 0 THEN 'other' WHEN 1 THEN 'unfilled' ELSE 'answer' END AS kind, CASE WHEN k % 7 < 2 THEN '' WHEN k % 3 = 0 THEN 'closed ORD-' || k ELSE 'wrote ' || k || '|read it again' END AS done,
  CASE WHEN k % 7 < 2 OR k % 4 = 0 THEN '' ELSE 'next of ' || k END AS focus, CASE WHEN k % 7 < 2 OR k % 5 <> 0 THEN '' ELSE 'Pending the key of ' || k || ' <@U1234567|Nok>@U1234567|Pending PO@PO' END AS blockers FROM (SELECT DISTINCT o_orderkey AS k FROM orders)
"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items of two customers each; the message of evidence is the first one's own."""
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("c"), F.min("o_orderstatus").alias("s"))
    k, who = F.col("o_orderkey").cast("string"), lambda c: F.concat(F.lit("U"), F.lpad(c.cast("string"), 8, "0"))
    state = F.when(F.col("s") == "F", "done").when(F.col("o_orderkey") % 3 == 0, "blocked").otherwise("moving")
    made = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ORD-"), F.pmod("o_orderkey", F.lit(100000)).cast("string"))).otherwise(F.concat(F.lit("c"), k)).alias("item"), F.concat(F.lit("head "), k).alias("headline"), state.alias("state"), F.pmod("o_orderkey", F.lit(9)).cast("double").alias("age_days"), (F.lit(1e6) - F.pmod("o_orderkey", F.lit(5)) * 86400.0).alias("last_ts"), F.array(who(F.col("c")), who(F.col("c") + 1), F.lit("Some Name")).alias("participants"), F.concat(F.lit("evidence "), k).alias("evidence"), F.concat(F.lit("e"), k).alias("evidence_id"), who(F.col("c")).alias("author"))
    said = made.select("item", F.col("evidence_id").alias("id"), F.col("author").alias("user"), F.concat(F.lit("waiting: "), "headline").alias("text"))
    return dailies.drafts(made, said, F.lit(1e6), 1.0, 6.0)


def standup_drafts(spark: SparkSession, d: str) -> DataFrame:
    return _drafts(spark, d).select("user", "part", "item", "note", "stale_days")


_DRAFTS = """
o AS (SELECT o_orderkey AS k, min(o_custkey) AS c, min(o_orderstatus) AS s FROM orders GROUP BY ALL),
  i AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'ORD-' || (k % 100000) ELSE 'c' || k END AS item, CASE WHEN s = 'F' THEN 'done' WHEN k % 3 = 0 THEN 'blocked' ELSE 'moving' END AS state FROM o),
  p AS (SELECT *, 'U' || lpad((c + g)::VARCHAR, 8, '0') AS "user", g FROM i CROSS JOIN (VALUES (0), (1)) t(g)),
  m AS (SELECT "user", 'yesterday' AS part, item, 'head ' || k AS headline, 'evidence ' || k AS note, NULL::BIGINT AS stale_days FROM p WHERE k % 5 <= 1
        UNION ALL SELECT "user", 'carried', item, 'head ' || k, NULL, k % 9 FROM p WHERE state <> 'done' AND k % 9 > 6),
  dr AS (SELECT * FROM m UNION ALL SELECT "user", 'blocked', item, 'head ' || k, 'waiting: head ' || k, NULL FROM p WHERE state = 'blocked' AND g = 0 AND "user" IN (SELECT "user" FROM m))"""


def standup_boxes(spark: SparkSession, d: str) -> DataFrame:
    return dailies.offered(_drafts(spark, d)).select("user", "part", F.col("place").cast("bigint").alias("place"), "text")


_BOXES = f"""
WITH {_DRAFTS}, t AS (SELECT *, item LIKE 'ORD-%' AS ticket, CASE WHEN item LIKE 'ORD-%' THEN item || ' ' || headline ELSE headline END AS line FROM dr),
  x AS (SELECT "user", 'done' AS part, row_number() OVER (PARTITION BY "user" ORDER BY item) AS place, line AS text, 5 AS most FROM t WHERE part = 'yesterday'
    UNION ALL SELECT "user", 'today', row_number() OVER (PARTITION BY "user" ORDER BY ticket DESC, stale_days DESC, item), line, 3 FROM t WHERE part = 'carried'
    UNION ALL SELECT "user", 'today', row_number() OVER (PARTITION BY "user" ORDER BY item), line, 3 FROM t WHERE part = 'yesterday' AND "user" NOT IN (SELECT "user" FROM t WHERE part = 'carried')
    UNION ALL SELECT "user", 'blocker', row_number() OVER (PARTITION BY "user" ORDER BY item), 'Pending ' || note || CASE WHEN ticket THEN ' (' || item || ')' ELSE '' END, 3 FROM t WHERE part = 'blocked')
SELECT "user", part, place, text FROM x WHERE place <= most
"""


def day_before(spark: SparkSession, d: str) -> DataFrame:
    """For each day of orders the last working day of orders before it."""
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    found = dailies.day_before(o.where(F.dayofweek("date").between(2, 6) & (F.dayofyear("date") > 20)), o)
    return found.select(F.col("date").cast("string").alias("date"), F.col("previous").cast("string").alias("previous"))


def without_simulated(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    days = e.select("date").distinct().select("date", F.when(F.dayofmonth("date") % 3 != 0, "1.0").alias("ts"), (F.dayofmonth("date") % 2 == 0).alias("simulated"))
    kept, answers = dailies.without_simulated(days, e.select("date", F.col("user_id").alias("user"), (F.col("event_id") % 5 == 0).alias("simulated")))
    return kept.join(answers.groupBy("date").agg(F.count(F.lit(1)).alias("answers")), "date", "left").select(F.col("date").cast("string").alias("date"), F.coalesce("answers", F.lit(0)).cast("bigint").alias("answers"))


def morning_post(spark: SparkSession, d: str) -> DataFrame:
    blockers, days = _dailies(spark, d)
    answers = table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("user_id").alias("user"))
    last = days.agg(F.max("date").cast("string")).first()[0]  # one value
    found = dailies.morning_post(days, answers, drift.streaks(blockers, days), last)
    return found.select(F.col("place").cast("bigint").alias("place"), "user", "blocker", "days", F.col("previous").cast("string").alias("previous"), F.col("answered").cast("bigint").alias("answered"), F.col("more").cast("bigint").alias("more"))


_MORNING = f"""
WITH {_DAILIES}, p AS (SELECT max(date) AS previous FROM dy WHERE date < (SELECT max(date) FROM dy))
SELECT row_number() OVER (ORDER BY days DESC, "user", blocker) AS place, "user", blocker, days, previous::VARCHAR AS previous, (SELECT count(DISTINCT user_id) FROM events WHERE ts::DATE = previous) AS answered, greatest((SELECT count(*) FROM sk) - 5, 0) AS more FROM sk CROSS JOIN p QUALIFY place <= 5
"""


def dates_read(spark: SparkSession, d: str) -> DataFrame:
    """Times of events as texts of three shapes, read again; and the three working days before each."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    whole = F.date_trunc("second", "ts")
    iso = F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(iso, F.lit("+0700"))).otherwise(iso)
    before = F.transform(when.workdays_before(F.to_date("ts"), 3), lambda x: x.cast("string"))
    return e.select("event_id", when.instant(text, "Asia/Bangkok").cast("bigint").alias("at"), F.array_join(before, ",").alias("workdays"), when.clock_in(F.unix_micros(whole) / 1e6, "Asia/Bangkok").alias("clock"), when.minute_of(F.date_format("ts", "H:mm")).cast("bigint").alias("minute"))


_DATES = """
SELECT event_id, epoch(date_trunc('second', ts))::BIGINT - CASE WHEN event_id % 3 = 0 THEN 0 ELSE 25200 END AS at, strftime(date_trunc('second', ts) + INTERVAL 7 HOUR, '%H:%M') AS clock, hour(ts) * 60 + minute(ts) AS minute,
  array_to_string(list_transform(list_reverse(list_filter([ts::DATE - i::INT for i in range(1, 9)], lambda x: isodow(x) <= 5)[1:3]), lambda x: x::VARCHAR), ',') AS workdays FROM events
"""


# chat, names and transcripts


def chat_export(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as recorded channels, read back through the chat source, page by page and thread by thread."""
    c = table(spark, d, "conversations")
    ts = lambda turn: F.format_string("%d.%06d", F.col("conv_id"), turn)
    size = c.groupBy("conv_id").agg((F.count(F.lit(1)) - 1).alias("reply_count"))
    rows = c.join(size, "conv_id").select(F.format_string("C%d", F.pmod("conv_id", F.lit(5))).alias("channel"), ts(F.col("turn")).alias("ts"), F.when(F.col("reply_count") > 0, ts(F.lit(0))).alias("thread_ts"), F.col("role").alias("user"), "text", F.when(F.col("turn") == 0, F.col("reply_count")).otherwise(0).alias("reply_count"))
    path = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    rows.write.partitionBy("channel").json(path)
    spark.dataSource.register(chat.Chat)
    found = spark.read.format("chat").option("transport", "colloquy.sources.chat:recorded").option("path", path).option("page", "7").option("own", "system").load()
    return found.select("channel", "ts", "user", "is_reply", F.length("text").cast("bigint").alias("n"))


_CHAT = """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN turn = 0 THEN role END) OVER (PARTITION BY conv_id) AS head FROM conversations)
SELECT 'C' || (conv_id % 5) AS channel, conv_id || '.' || lpad(turn::VARCHAR, 6, '0') AS ts, role AS "user", turn > 0 AS is_reply, length(text) AS n FROM c WHERE role <> 'system' AND head IS NOT NULL AND head <> 'system'
"""

#: The second at which the recorded conversations begin.
_BEGUN = 1_700_000_000
_CHAT_STREAM = f"""
WITH h AS (SELECT conv_id FROM conversations WHERE turn = 0)
SELECT 'C' || (conv_id % 5) AS channel, ({_BEGUN} + conv_id + 50 * turn) || '.' || lpad(turn::VARCHAR, 6, '0') AS ts, role AS "user", turn > 0 AS is_reply, length(text) AS n FROM conversations SEMI JOIN h USING (conv_id)
"""


def chat_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same channels as a stream: three parts by time, each into the store and then read on from the last offsets.

    A conversation's turns are 50 seconds apart, so that replies come to heads of earlier parts.
    """
    c = table(spark, d, "conversations")
    at = lambda turn: F.format_string("%d.%06d", F.lit(_BEGUN) + F.col("conv_id") + 50 * turn, turn)
    rows = c.select(F.format_string("C%d", F.pmod("conv_id", F.lit(5))).alias("channel"), at(F.col("turn")).alias("ts"), F.when(F.col("turn") > 0, at(F.lit(0))).alias("thread_ts"), F.col("role").alias("user"), "text")
    sec = F.floor(F.col("ts").cast("double"))
    low, high = rows.agg(F.min(sec), F.max(sec)).first()
    base = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    spark.dataSource.register(chat.Chat)
    for part in range(3):
        rows.where(F.floor((sec - low) / ((high - low) / 3 + 1e-3)) == part).write.mode("append").partitionBy("channel").json(f"{base}/in")
        said = spark.readStream.format("chat").option("transport", "colloquy.sources.chat:recorded").option("path", f"{base}/in").option("span", "500").load()
        keyed = said.withColumn("key", F.concat_ws("/", "channel", "ts")).withColumn("at", F.timestamp_seconds(F.col("ts").cast("double")))
        once = jobs.deduplicated(keyed, "key", "at", "7 days")
        once.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("channel", "ts", "user", "is_reply", F.length("text").cast("bigint").alias("n"))


def names_known(spark: SparkSession, d: str) -> DataFrame:
    """Members' best names, how often the corpus has each id, and a text that mentions two of them."""
    c = table(spark, d, "customer").select("c_custkey")
    id_ = F.concat(F.lit("U"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    pick = lambda k, value: F.when(F.col("c_custkey") % 5 == k, value).otherwise("  ")
    n = F.col("c_custkey").cast("string")
    profile = F.struct(pick(0, F.concat(F.lit(" shown "), n)).alias("display_name"), pick(1, F.concat(F.lit("real "), n)).alias("real_name"))
    members = c.select(id_.alias("id"), pick(2, F.concat(F.lit("handle "), n)).alias("name"), pick(3, F.concat(F.lit("own "), n)).alias("real_name"), (F.col("c_custkey") % 10 == 0).alias("is_bot"), profile.alias("profile"))
    known = chat.best_names(members)
    o = table(spark, d, "orders").groupBy("o_orderkey").agg(F.min("o_custkey").alias("c"))
    who = lambda x: F.concat(F.lit("U"), F.lpad(x.cast("string"), 9, "0"))
    said = chat.names_in_text(o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("hi @"), who(F.col("c")), F.lit(", ask @"), who(F.col("c") + 1), F.lit(" not "), who(F.col("c"))).alias("text")), known)
    spoke = chat.ids_of_corpus(o.select(F.when(F.col("c") % 2 == 0, who(F.col("c"))).otherwise("Some Name").alias("user")))
    return said.join(o, said["id"] == o["o_orderkey"]).withColumn("user", who(F.col("c"))).join(spoke, "user", "left").select("id", "text", "n")


_NAMES = """
WITH nm AS (SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'shown ' WHEN 1 THEN 'real ' WHEN 2 THEN 'handle ' WHEN 3 THEN 'own ' END || c_custkey || CASE WHEN c_custkey % 10 = 0 THEN ' (bot)' ELSE '' END AS name FROM customer),
  o AS (SELECT o_orderkey AS id, min(o_custkey) AS c FROM orders GROUP BY ALL), s AS (SELECT c, count(*) AS n FROM o WHERE c % 2 = 0 GROUP BY ALL)
SELECT id, 'hi @' || coalesce(a.name, 'U' || lpad(o.c::VARCHAR, 9, '0')) || ', ask @' || coalesce(b.name, 'U' || lpad((o.c + 1)::VARCHAR, 9, '0')) || ' not U' || lpad(o.c::VARCHAR, 9, '0') AS text, n
FROM o LEFT JOIN nm a ON a.k = o.c LEFT JOIN nm b ON b.k = o.c + 1 LEFT JOIN s ON s.c = o.c
"""


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as lines that every transcript format can hold."""
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("says "), F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("said"))


def vtt_udtf(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as subtitle files, speech recogniser's rows and lines with names, by their number, read again."""
    s = _spoken(spark, d)
    at = F.col("turn") * 95.5
    stamp = F.format_string("%02d:%02d:%06.3f --> 99:00.000", F.floor(at / 3600).cast("int"), F.floor(at / 60).cast("int") % 60, at % 60)
    cue = F.concat(F.lit("cue-"), F.col("turn").cast("string"), F.lit("\n"), stamp, F.lit("\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("<v "), "role", F.lit(">"), "said", F.lit("</v>"))).otherwise(F.concat("role", F.lit(": "), F.lit("<i>"), "said", F.lit("</i>"))), F.lit("\n"))
    row = F.to_json(F.struct(F.col("role").alias("speaker"), (F.col("turn") * 2.5).alias("start"), F.col("said").alias("text")))
    joined = lambda c, by: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", c.alias("x")))), lambda p: p["x"]), by)
    g = s.groupBy("conv_id").agg(joined(cue, "\n").alias("vtt"), joined(row, ",").alias("json"), joined(F.concat("role", F.lit(" : "), "said"), "\n").alias("lines"))
    kind = F.col("conv_id") % 3
    files = g.select(F.concat(F.lit("f"), F.col("conv_id").cast("string"), F.when(kind == 0, ".vtt").when(kind == 1, ".json").otherwise(".txt")).alias("path"), F.when(kind == 0, F.concat(F.lit("WEBVTT\n\n"), "vtt")).when(kind == 1, F.concat(F.lit("["), "json", F.lit("]"))).otherwise(F.col("lines")).alias("text"))
    return transcripts.utterances(files).select("path", F.col("pos").cast("bigint").alias("pos"), "offset", "user", "text")


_SPOKEN = "s AS (SELECT conv_id, turn, role, trim('says ' || regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth FROM conversations)"


def paste_udtf(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as pasted chats, a turn every seven hours, which crosses midnight; read again."""
    s = _spoken(spark, d)
    minute = F.pmod(F.lit(540) + F.col("turn") * 420, F.lit(1440))
    hour = F.floor(minute / 60).cast("int")
    half = F.when(hour < 12, "AM").otherwise("PM")
    clock = F.when(F.col("turn") % 2 == 0, F.concat(F.format_string("%d:%02d ", F.when(hour % 12 == 0, 12).otherwise(hour % 12), minute.cast("int") % 60), half)).otherwise(F.format_string("%02d:%02d", hour, minute.cast("int") % 60))
    text = F.concat("role", F.lit("  ["), clock, F.lit("]\n"), "said", F.when(F.col("turn") % 4 == 1, " (edited)").otherwise(""), F.lit("\n:tada: 2\nview thread\nand more of it"))
    g = s.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("x")))), lambda p: p["x"]), "\n").alias("text"))
    files = g.select(F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), F.lit("2026-01-05").cast("date").alias("day"), F.concat(F.lit("above\n"), "text").alias("text"))
    return transcripts.pasted(files).select("title", F.col("pos").cast("bigint").alias("pos"), F.col("ts").cast("bigint").alias("at"), "user", "text", "skipped")


# recall and measures


def local_search_recent(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages against conversation turns, by characters, words and recency."""
    r = conversation_records(spark, d).select("id", "text", "ts")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return recall.local_search(r, asked).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


_CONTENT = r"""
docs AS (SELECT 'msg_' || conv_id || '_' || turn AS id, text, conv_id * 3600.0 + turn * 60.0 AS ts, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM conversations),
  qs AS (SELECT item_id AS query_id, text, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM benchmark),
  a AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) AS g FROM docs) GROUP BY ALL),
  b AS (SELECT query_id, g, count(*) AS m FROM (SELECT query_id, unnest([substr(t, i, 3) for i in range(1, length(t) - 1)]) AS g FROM qs) GROUP BY ALL),
  sa AS (SELECT id, sqrt(sum(n * n)) AS sn FROM a GROUP BY ALL), sb AS (SELECT query_id, sqrt(sum(m * m)) AS sm FROM b GROUP BY ALL),
  nr AS (SELECT query_id, id, sum(n * m) / (any_value(sn) * any_value(sm)) AS near FROM a JOIN b USING (g) JOIN sa USING (id) JOIN sb USING (query_id) GROUP BY ALL),
  dw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._-]{2,}')) AS w FROM docs), qw AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9._-]{2,}')) AS w FROM qs),
  sh AS (SELECT query_id, id, count(*) AS shared FROM dw JOIN qw USING (w) GROUP BY ALL), qn AS (SELECT query_id, count(*) AS n FROM qw GROUP BY ALL),
  both_ AS (SELECT query_id, id, coalesce(near, 0) AS near, coalesce(shared / n, 0) AS words FROM nr FULL JOIN sh USING (query_id, id) LEFT JOIN qn USING (query_id))"""


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as decisions, of which each supersedes the one before."""
    r = conversation_records(spark, d)
    after = r.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("id").alias("superseded_by"))
    return r.join(after, ["conv_id", "turn"], "left").select("id", "text", "superseded_by")


def recall_answer(spark: SparkSession, d: str) -> DataFrame:
    """What recall says to each benchmark passage: three decisions, each with its successors, and the six best messages."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = recall.local_search(conversation_records(spark, d).select("id", "text", "ts"), asked)
    return recall.answer(_decisions(spark, d), hits, asked)


_RECALL = f"""
WITH RECURSIVE {_CONTENT}, lo AS (SELECT query_id, id, c * (0.9 + 0.1 * exp(-((SELECT max(ts) FROM docs) - ts) / 86400 / 120)) AS score FROM (SELECT *, 0.65 * near + 0.35 * words AS c FROM both_) JOIN docs USING (id) WHERE c >= 0.04),
  hi AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM lo QUALIFY place <= 6),
  de AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * near + 0.3 * words, 9) DESC, id) AS place FROM both_ WHERE 0.7 * near + 0.3 * words > 0.04 QUALIFY place <= 3),
  nx AS (SELECT 'msg_' || a.conv_id || '_' || a.turn AS id, 'msg_' || b.conv_id || '_' || b.turn AS nxt FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
  ch(query_id, id, place, step) AS (SELECT query_id, id, place, 0::BIGINT FROM de UNION ALL SELECT query_id, nxt, place, step + 1 FROM ch JOIN nx USING (id))
SELECT query_id, 'decision' AS kind, id, place, step FROM ch UNION ALL SELECT query_id, 'message', id, place, 0 FROM hi
"""


def found_by_depth(spark: SparkSession, d: str) -> DataFrame:
    _, hits, sizes = _ranked(spark, d)
    found = evaluation.depths_of(hits, sizes, [1, 5, 10, 25, 50])
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in ("depth", "found", "total", "reachable", "first_correct")])


_DEPTH = f"""
WITH {_COS}, r AS (SELECT query_id, q_label = label AS hit, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM c),
  n AS (SELECT query_id, count(*) AS n FROM c WHERE q_label = label GROUP BY ALL)
SELECT depth, (SELECT count(*) FROM r WHERE hit AND rank <= depth) AS found, (SELECT sum(n) FROM n)::BIGINT AS total, (SELECT sum(least(n, depth)) FROM n)::BIGINT AS reachable, (SELECT count(*) FROM r WHERE hit AND rank = 1) AS first_correct FROM (VALUES (1::BIGINT), (5), (10), (25), (50)) t(depth)
"""


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    r = conversation_records(spark, d).withColumn("pos", F.col("turn"))
    return evaluation.label_counts(evaluation.weak_cases(r), r.select(F.col("id").alias("query_id"), "thread_ts"))


def strong_relations(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("target"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("score"))
    return relations.strong(r, 0.05).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def tickets_of_projects(spark: SparkSession, d: str) -> DataFrame:
    """Orders of three priorities as projects that share some keys: the first project's ticket stays."""
    o = table(spark, d, "orders").select(F.concat(F.lit("ORD-"), F.pmod("o_orderkey", F.lit(700)).cast("string")).alias("ticket"), F.col("o_orderpriority").alias("project"))
    parts = [o.where(F.col("project").startswith(p)).distinct() for p in ("1", "2", "3")]
    return tracker.all_projects(parts)


QUERIES = {
    f.__name__: f
    for f in (
        board_items, board_blocks, board_lists, item_headlines, card_titles, items_named, people_named, items_of_person, strays, hits_placed, drifts_resolved, ids_decoded, blockers_stated,
        daily_replies, standup_drafts, standup_boxes, day_before, without_simulated, morning_post, dates_read, chat_export, chat_stream, names_known, vtt_udtf, paste_udtf,
        local_search_recent, recall_answer, found_by_depth, label_counts, strong_relations, tickets_of_projects,
    )
}

ORACLE = {
    "board_items": f"WITH {_BOARD} SELECT item, headline, state, evidence, evidence_id, age_days FROM bd",
    "board_blocks": f"WITH {_BOARD}, p AS (SELECT item, row_number() OVER (ORDER BY {_PLACE}, age_days DESC, item) AS place, count(*) OVER () AS n FROM bd) SELECT item, place, CASE WHEN n > 48 THEN n - 47 ELSE 0 END AS omitted FROM p WHERE place <= 47 OR n <= 48",
    "board_lists": f"WITH {_BOARD}, x AS (SELECT * FROM bd WHERE contains(lower(headline || ' ' || item || ' ' || state), 't-1')), y AS (SELECT 'urgency' AS sorted_by, item, row_number() OVER (ORDER BY {_PLACE}, item) AS k FROM x UNION ALL SELECT 'age', item, row_number() OVER (ORDER BY age_days DESC, item) FROM x UNION ALL SELECT 'recent', item, row_number() OVER (ORDER BY age_days, item) FROM x UNION ALL SELECT 'size', item, row_number() OVER (ORDER BY length(evidence) DESC, item) FROM x) SELECT sorted_by, item FROM y WHERE k <= 7",
    "item_headlines": "WITH r AS (SELECT conv_id AS item, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), t AS (SELECT item, split_part(arg_max(text, (length(text), -k)), chr(10), 1) AS l FROM r WHERE k <= 3 GROUP BY item) SELECT item, CASE WHEN length(l) > 90 THEN substr(l, 1, 88) || '…' WHEN l = '' THEN '(ไม่มีหัวข้อ)' ELSE l END AS headline FROM t",
    "card_titles": _CARDS,
    "items_named": "WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders), q AS (SELECT k, CASE k % 3 WHEN 2 THEN k || '9' ELSE k::VARCHAR END AS w FROM o) SELECT q.k AS query_id, 'ORD-' || o.k AS item FROM q JOIN o ON o.k::VARCHAR = w",
    "people_named": "WITH c AS (SELECT 'U' || c_custkey AS u, 'Name ' || c_nationkey AS n FROM customer), m AS (SELECT n, min(u) AS u FROM c GROUP BY n) SELECT DISTINCT CASE WHEN c.u LIKE '%0' THEN upper(c.n) ELSE c.u END AS asked, CASE WHEN c.u LIKE '%0' THEN m.u ELSE c.u END AS user FROM c JOIN m USING (n)",
    "items_of_person": "WITH o AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'), p AS (SELECT o_custkey AS c, o_orderkey AS k FROM o UNION SELECT o_custkey + 1, o_orderkey FROM o) SELECT c AS custkey, 'ORD-' || k AS item FROM p WHERE c IN (SELECT c_custkey FROM customer)",
    "strays": f"WITH {_LINES}, m AS (SELECT 'm' || l_orderkey || '_' || l_linenumber AS id, l_suppkey % 40 AS topic FROM li), o AS (SELECT DISTINCT 'm' || o_orderkey || '_1' AS id, o_orderkey % 60 AS topic FROM orders) SELECT o.topic, id, 'ORD-' || m.topic AS elsewhere FROM o JOIN m USING (id) WHERE o.topic <> m.topic AND o.topic IN (SELECT topic FROM m)",
    "hits_placed": f"WITH {_LINES}, o AS (SELECT DISTINCT o_orderkey FROM orders) SELECT 'm' || l_orderkey || '_' || l_linenumber AS id, l_suppkey % 40 + CASE WHEN (l_orderkey * 10 + l_linenumber) % 4 = 0 THEN 100 ELSE 0 END AS topic, CASE WHEN l_linenumber = 2 AND o_orderkey IS NOT NULL AND NOT contains('ord-' || (l_orderkey % 500), 'ord-' || (l_orderkey % 499)) THEN 'ord-' || (l_orderkey % 499) END AS linked FROM li LEFT JOIN o ON o_orderkey = l_orderkey",
    "drifts_resolved": f"WITH {_LINES} SELECT 'ord-' || l_orderkey AS item, 'm' || l_orderkey || '_' || l_linenumber AS trigger FROM li WHERE l_linenumber = l_orderkey % 9 + 1 AND l_orderkey % 4 <> 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)",
    "ids_decoded": _IDS,
    "blockers_stated": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'waiting for ' || doc_id ELSE 'first of ' || doc_id END AS blocker, CASE WHEN lang LIKE 'd%' THEN 'agreed on d' ELSE 'agreed' END AS cue FROM documents",
    "daily_replies": _REPLIES,
    "standup_drafts": f'WITH {_DRAFTS} SELECT "user", part, item, note, stale_days FROM dr',
    "standup_boxes": _BOXES,
    "day_before": "WITH o AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), w AS (SELECT date FROM o WHERE isodow(date) <= 5 AND dayofyear(date) > 20) SELECT o.date::VARCHAR AS date, max(w.date)::VARCHAR AS previous FROM o LEFT JOIN w ON w.date < o.date GROUP BY o.date",
    "without_simulated": "WITH e AS (SELECT ts::DATE AS date, event_id FROM events) SELECT date::VARCHAR AS date, count(CASE WHEN event_id % 5 <> 0 THEN 1 END) AS answers FROM e WHERE NOT (day(date) % 2 = 0 AND day(date) % 3 = 0) GROUP BY date",
    "morning_post": _MORNING,
    "dates_read": _DATES,
    "chat_export": _CHAT,
    "chat_stream": _CHAT_STREAM,
    "names_known": _NAMES,
    "vtt_udtf": f"WITH {_SPOKEN} SELECT 'f' || conv_id || CASE conv_id % 3 WHEN 0 THEN '.vtt' WHEN 1 THEN '.json' ELSE '.txt' END AS path, nth AS pos, CASE conv_id % 3 WHEN 0 THEN turn * 95.5 WHEN 1 THEN turn * 2.5 ELSE nth * 20.0 END::DOUBLE AS \"offset\", role AS \"user\", said AS text FROM s",
    "paste_udtf": f"WITH {_SPOKEN} SELECT 'chat ' || conv_id AS title, nth AS pos, epoch(TIMESTAMP '2026-01-05 09:00:00' + INTERVAL 7 HOUR * turn)::BIGINT AS at, role AS \"user\", said || chr(10) || 'and more of it' AS text, false AS skipped FROM s UNION ALL SELECT DISTINCT 'chat ' || conv_id, -1, NULL, '', 'above', true FROM s",
    "local_search_recent": f"WITH {_CONTENT}, f AS (SELECT query_id, id, c * (0.9 + 0.1 * exp(-((SELECT max(ts) FROM docs) - ts) / 86400 / 120)) AS score FROM (SELECT *, 0.65 * near + 0.35 * words AS c FROM both_) JOIN docs USING (id) WHERE c >= 0.04) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, round(score, 6) AS score FROM f QUALIFY rank <= 8",
    "recall_answer": _RECALL,
    "found_by_depth": _DEPTH,
    "label_counts": f"WITH {RECORDS}, p AS (SELECT id, thread_ts, row_number() OVER (PARTITION BY thread_ts ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY thread_ts) AS n FROM rec) SELECT sum(n - 1)::BIGINT AS pairs, count(*) AS queries, count(DISTINCT thread_ts) AS threads FROM p WHERE n >= 4 AND k % greatest(n // 3, 1) = 0 AND k / greatest(n // 3, 1) < 3",
    "strong_relations": "SELECT l_returnflag AS relation, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL",
    "tickets_of_projects": "WITH o AS (SELECT DISTINCT 'ORD-' || (o_orderkey % 700) AS ticket, o_orderpriority AS project FROM orders WHERE o_orderpriority < '4') SELECT ticket, min(project) AS project FROM o GROUP BY ticket",
}
