"""What state a work item is in, and which message proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import text as T

#: Relations that decide a state, and those that only show movement.
DECIDING, MOVING = ["resolves", "blocked_by"], ["duplicates", "follows_up", "answers"]
#: Shortest answer and shortest line that say something.
LEAST_ANSWER, LEAST_LINE = 15, 12
#: Headings of a standup form; a line that is nothing else opens a slot.
FORM = r"(?i)^[\s•*\-–—]*\**\s*(?:what did .*yesterday|progress on pending task|what are you working on today|are there any blockers|blockers?|others|upcoming event.*|timeline)\s*\**\s*\??\s*:?\s*$"
BOLD_HEADING = r"^\s*\*+([^*]{2,60})\*+\s*:?\s*$"
WAITING_HEADING = r"(?i)(pending|blocked|blocker|on hold|ค้าง|ติดอยู่|รอ)"


def may_decide(is_bot: Column, said: Column, size: Column) -> Column:
    """A bot may not decide a state, nor may a bare acknowledgement in a large item."""
    return ~F.coalesce(is_bot, F.lit(False)) & ~((F.length(said) <= cues.ACK_CHARS) & (size > cues.ACK_TOPIC))


def inferred(relations: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, state, evidence_id, since, moved_id): by the latest deciding relation between two records of a topic.

    relations(source, target, relation, evidence), topics(id, topic, ts, is_bot, said). Records without a time count as
    the oldest; of equally late relations the greatest target id wins. A topic without any is active.
    """
    sizes = topics.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    to = topics.select(F.col("id").alias("target"), "topic", F.coalesce("ts", F.lit(0.0)).alias("at"), "is_bot", "said")
    inside = relations.join(to, "target").join(topics.select(F.col("id").alias("source"), F.col("topic").alias("topic2")), "source").where("topic = topic2").join(sizes, "topic")
    some = inside.where(F.col("relation").isin(DECIDING + MOVING))
    decides = F.col("relation").isin(DECIDING) & may_decide(F.col("is_bot"), F.col("said"), F.col("size"))
    row = F.struct("at", "target", "relation", "evidence")
    latest = some.groupBy("topic").agg(F.max(F.when(decides, row)).alias("d"), F.max(row).alias("m"))
    state = F.when(F.col("d").isNull(), "active").when(F.col("d.relation") == "resolves", "resolved").otherwise("blocked")
    moved = F.when(F.col("d").isNull() | (F.col("m.at") > F.col("d.at")), F.col("m.target"))
    found = latest.select("topic", state.alias("state"), F.coalesce("d.target", "m.target").alias("evidence_id"), F.coalesce("d.at", "m.at").alias("since"), moved.alias("moved_id"))
    return sizes.select("topic").join(found, "topic", "left").withColumn("state", F.coalesce("state", F.lit("active")))


def form_slots(records: DataFrame) -> DataFrame:
    """(id, user, ts, slot, pos, answer): the answers of standup forms; a slot that was opened but not answered has one null answer.

    Only records with a heading are taken apart.
    """
    raw = F.split(F.coalesce("text", F.lit("")), r"\r\n|[\n\r]")
    forms = records.where(F.exists(raw, lambda x: T.collapse(x).rlike(FORM)))
    lines = forms.select("id", "user", "ts", F.posexplode(raw).alias("pos", "raw")).withColumn("line", T.collapse(F.col("raw")))
    heading = F.col("line").rlike(FORM)
    slot = F.when(F.col("line").rlike("(?i)yesterday|pending task"), "yesterday").when(F.col("line").rlike("(?i)today"), "today").when(F.col("line").rlike("(?i)blocker"), "blockers").otherwise("other")
    carried = Window.partitionBy("id").orderBy("pos")
    opened = lines.withColumn("slot", F.last(F.when(heading, slot), ignorenulls=True).over(carried)).where("slot is not null")
    return opened.withColumn("answer", F.when(~heading & (F.col("line") != ""), F.col("line"))).where(F.col("answer").isNotNull() | heading).select("id", "user", "ts", "slot", "pos", "answer")


def says_something(answer: Column) -> Column:
    return ~answer.rlike(T.EMPTY_ANSWER) & (F.length(F.trim(answer, F.lit(" •*-–—"))) >= LEAST_ANSWER)


def declared(slots: DataFrame) -> DataFrame:
    """(id, user, ts, answers): blockers that people declared themselves."""
    some = slots.where("slot = 'blockers' and answer is not null").where(says_something(F.col("answer")))
    return some.groupBy("id", "user", "ts").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "answer"))), lambda x: x["answer"]).alias("answers"))


def cleared(slots: DataFrame) -> DataFrame:
    """(user, cleared): when each person last answered that there are no blockers."""
    answers = slots.where("slot = 'blockers' and answer is not null").groupBy("id", "user", "ts").agg(F.bool_or(says_something(F.col("answer"))).alias("any"))
    return answers.where("not any and ts is not null").groupBy("user").agg(F.max("ts").alias("cleared"))


def is_form(slots: DataFrame) -> DataFrame:
    """(id): messages that are a filled-in form: the blockers slot and another one."""
    return slots.groupBy("id").agg(F.countDistinct("slot").alias("n"), F.bool_or(F.col("slot") == "blockers").alias("b")).where("b and n >= 2").select("id")


def waiting_lines(records: DataFrame) -> DataFrame:
    """(id, user, ts, pos, line, cue, waiting_on, from_heading): lines that say something waits.

    A cue makes a line one, unless finished work governs it; so does a bold heading about waiting above it. Questions,
    fragments and records of the tracker don't count. Only records with a cue or such a heading are taken apart.
    """
    own = records.where("coalesce(source, '') != 'youtrack'") if "source" in records.columns else records
    said = own.select("id", "user", "ts", T.asserted_lines(F.coalesce("text", F.lit(""))).alias("said"))
    some = said.where(F.exists("said", lambda x: T.has_cue(T.unbullet(x), cues.WAITING) | F.regexp_extract(x, BOLD_HEADING, 1).rlike(WAITING_HEADING)))
    lines = some.select("id", "user", "ts", F.posexplode("said").alias("pos", "raw"))
    head = F.regexp_extract("raw", BOLD_HEADING, 1)
    carried = Window.partitionBy("id").orderBy("pos")
    under = F.coalesce(F.last(F.when(head != "", head.rlike(WAITING_HEADING)), ignorenulls=True).over(carried), F.lit(False))
    body = lines.withColumn("under", under).where(head == "").withColumn("line", T.unbullet(F.col("raw"))).where((F.length("line") >= LEAST_LINE) & ~F.col("line").rlike(r"[?？]\s*$"))
    hit = body.withColumn("cue", T.first_cue(F.col("line"), cues.WAITING))
    kept = hit.where((F.col("cue").isNotNull() & ~T.completion_governs(F.col("line"), F.col("cue"))) | (F.col("cue").isNull() & F.col("under")))
    return kept.select("id", "user", "ts", "pos", "line", F.coalesce("cue", F.lit("heading")).alias("cue"), T.waiting_on(F.col("line")).alias("waiting_on"), F.col("cue").isNull().alias("from_heading"))


def with_declarations(states: DataFrame, topics: DataFrame, declarations: DataFrame, clearances: DataFrame) -> DataFrame:
    """States, with blockers that people declared above what was inferred.

    A declaration stands until its own author later says there is none; the latest that stands is the evidence.
    declarations(id, answers), clearances(user, cleared), topics(id, topic, user, ts).
    """
    made = topics.join(declarations.select("id", "answers"), "id").join(clearances, "user", "left")
    standing = made.where(F.col("cleared").isNull() | (F.col("cleared") <= F.col("ts")))
    last = standing.groupBy("topic").agg(F.max(F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), "id", "answers")).alias("s"))
    both = states.join(last, "topic", "left")
    has = F.col("s").isNotNull()
    return both.select(
        "topic",
        F.when(has, "blocked").otherwise(F.col("state")).alias("state"),
        F.when(has, F.col("s.id")).otherwise(F.col("evidence_id")).alias("evidence_id"),
        F.when(has, F.col("s.ts")).otherwise(F.col("since")).alias("since"),
        F.left(F.array_join("s.answers", " / "), F.lit(120)).alias("declared"),
    )


def timeline(relations: DataFrame, records: DataFrame) -> DataFrame:
    """(relation, to_id, ts, from_id, from_ts, also_answers): one event for each message and type; the earliest partner stays, the rest are counted."""
    side = lambda c, p: records.select(F.col("id").alias(c), F.col("ts").alias(p))
    some = relations.where(F.col("relation") != cues.UNTYPED).join(side("source", "from_ts"), "source").join(side("target", "ts"), "target")
    return some.groupBy("relation", "target").agg(F.min(F.struct("from_ts", "source")).alias("f"), F.max("ts").alias("ts"), (F.count(F.lit(1)) - 1).alias("also_answers")).select("relation", F.col("target").alias("to_id"), "ts", F.col("f.source").alias("from_id"), F.col("f.from_ts").alias("from_ts"), "also_answers")


def digest_order(state: Column, last: Column) -> list[Column]:
    """Blocked, active, resolved; within a state the latest first."""
    return [F.when(state == "blocked", 0).when(state == "active", 1).when(state == "resolved", 2).otherwise(1), F.desc_nulls_last(last)]


def in_window(topics: DataFrame, since: float, until: float, least: int = 2) -> DataFrame:
    """(topic, messages, first_ts, last_ts, people): topics of enough messages, at least half of them talk, touched in the window."""
    g = topics.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count(F.when(F.coalesce("source", F.lit("")) != "youtrack", 1)).alias("talked"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.sort_array(F.collect_set("user")).alias("people"),
        F.bool_or(F.col("ts").between(since, until)).alias("touched"),
    )
    return g.where((F.col("messages") >= least) & (F.col("talked") * 2 >= F.col("messages")) & F.col("touched")).drop("touched", "talked")
