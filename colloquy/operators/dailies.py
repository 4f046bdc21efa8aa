"""Daily reports: reading and writing replies, what a person may want to report, and what the next morning begins with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NOTHING, PLACEHOLDER, TICKET, bound
from .items import is_chat_id, stated_blocker

#: Headings that open a part of a reply, without marks and in lower case.
HEADINGS = {
    "done": ["done", "done yesterday", "yesterday", "เมื่อวาน", "เมื่อวานทำอะไร"],
    "focus": ["focus", "focus today", "today", "วันนี้", "วันนี้ทำอะไร"],
    "blockers": ["blockers", "blocker", "pending", "blockers pending", "ติดอะไร", "ที่ติด"],
}
#: How a line that ends in a colon begins, to be a heading of a part.
BEGINNINGS = {"done": ["done"], "focus": ["focus"], "blockers": ["blocker", "pending"]}
#: Words of which each heading and each beginning above has one.
WORDS = ["done", "yesterday", "เมื่อวาน", "focus", "today", "วันนี้", "blocker", "pending", "ติด"]
#: The headings that a written reply has, in order.
TITLES = [("done", "Done Yesterday:"), ("focus", "Focus Today:"), ("blockers", "Blockers / Pending:")]
#: Lines offered of what was done, and of each other part; characters of a blocker.
MOST_DONE, MOST_OFFERED, BLOCKER = 5, 3, 120


def is_nothing(line: Column) -> Column:
    """An answer that there is nothing."""
    return F.trim(line).rlike(NOTHING)


def is_placeholder(line: Column) -> Column:
    """A line of the form that was not filled in."""
    return (F.trim(line) == "") | line.rlike(PLACEHOLDER)


def heading_of(line: Column) -> Column:
    """The part that a line opens; null if it opens none."""

    def opened(bare: Column, words: Column) -> Column:
        out = F.lit(None).cast("string")
        for part, beginnings in reversed(BEGINNINGS.items()):
            out = F.when(bare.rlike(r":\s*$") & words.rlike(f"^(?:{'|'.join(beginnings)})"), part).otherwise(out)
        for part, phrases in HEADINGS.items():
            out = F.when(words.isin(phrases), part).otherwise(out)
        return out

    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^[*_~>•\-\d.\s]+", ""), "[*_~`]", "")
    words = lambda bare: F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r":\s*$", ""), r"\s*/\s*", " "), r"\s+", " ")))
    # most lines have none of the words that every heading has one of, and are not taken apart
    some = F.lower(F.translate(line, "*_~`", "")).rlike("|".join(WORDS))
    return F.when(some, bound(bare, lambda b: bound(words(b), lambda w: opened(b, w))))


def tag_of(line: Column) -> Column:
    """Whom a line waits for: a mentioned person's id, or PO; empty if it names neither."""
    mention = F.regexp_extract(line, r"<@([UW][A-Z0-9]{2,})(?:\|[^>]*)?>", 1)
    return F.when(mention != "", mention).when(line.rlike(r"(?:^|[^A-Za-z])PO(?:[^A-Za-z]|$)"), "PO").otherwise("")


def unbulleted(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(line), r"^[*_~>•\-–—\d).\s]+", ""))


def parsed_replies(replies: DataFrame) -> DataFrame:
    """(id, kind, done, focus, blockers): replies of a thread as answers. replies(id, text).

    kind is answer; unfilled, if a form came back as it was; other, if no line is a heading. Lines before the first
    heading count for nothing. blockers are (text, tag). A reply is read within its row, so nothing is shuffled.
    """

    def sections(lines: Column) -> Column:
        """(headings, each line under a heading with the part), of lines (raw, opens)."""
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["opens"].alias("part"))), lambda h: h["part"].isNotNull())

        def under(h: Column) -> Column:
            end = lambda j: F.coalesce(F.get(h, j + 1)["at"], F.size(lines))
            each = lambda x, j: F.transform(F.slice(lines, x["at"] + 2, end(j) - x["at"] - 1), lambda l: F.struct(x["part"].alias("part"), l["raw"].alias("raw"), unbulleted(l["raw"]).alias("text")))
            return F.struct(F.size(h).alias("headings"), F.flatten(F.transform(h, each)).alias("said"))

        return bound(heads, under)

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), lambda raw: F.struct(raw.alias("raw"), heading_of(raw).alias("opens")))
    cut = replies.select("id", bound(lines, sections).alias("cut"))
    said = F.filter("cut.said", lambda x: (x["text"] != "") & ~is_nothing(x["text"]))
    marked = cut.select("id", "cut.headings", F.transform(said, lambda x: F.struct(x["part"].alias("part"), x["raw"].alias("raw"), x["text"].alias("text"), is_placeholder(x["text"]).alias("form"))).alias("said"))
    told = marked.select("id", "headings", F.exists("said", lambda x: x["form"]).alias("unfilled"), F.filter("said", lambda x: ~x["form"]).alias("told"))
    kind = F.when(F.col("headings") == 0, "other").when((F.size("told") == 0) & F.col("unfilled"), "unfilled").otherwise("answer")
    of = lambda part, row: F.transform(F.filter("told", lambda x: x["part"] == part), row).alias(part)
    text = lambda x: x["text"]
    return told.select("id", kind.alias("kind"), of("done", text), of("focus", text), of("blockers", lambda x: F.struct(x["text"].alias("text"), tag_of(x["raw"]).alias("tag"))))


def composed(done: Column, focus: Column, blockers: Column, empty: str | None = None) -> Column:
    """The reply that a person would have typed: arrays of lines under the three headings; parsed_replies reads it back."""

    def lines(values: Column) -> Column:
        none = F.array().cast("array<string>")
        each = F.filter(F.transform(F.flatten(F.transform(F.coalesce(values, none), lambda v: F.split(F.coalesce(v, F.lit("")), r"\r?\n"))), lambda v: F.trim(v)), lambda x: x != "")
        return bound(each, lambda e: F.when(F.size(e) == 0, F.array(F.lit(empty))).otherwise(e)) if empty else each

    parts = [F.concat(F.array(F.lit(title)), lines(c)) for (_, title), c in zip(TITLES, (done, focus, blockers), strict=True)]
    return F.array_join(F.concat(parts[0], F.array(F.lit("")), parts[1], F.array(F.lit("")), parts[2]), "\n")


# what a person may want to report


def drafts(items: DataFrame, messages: DataFrame, now: Column, recent: float, stale: float) -> DataFrame:
    """(user, part, item, headline, note, stale_days, evidence_id): a row for each line of each participant's draft.

    Parts are yesterday (touched within ``recent`` days), carried (not done and older than ``stale`` days) and blocked
    (by the person's own words). A person without a line in the first two has no draft, nor has one without an id that
    can be written to. items(item, headline, state, age_days, last_ts, participants, evidence, evidence_id),
    messages(item, id, user, text).
    """
    each = items.withColumn("user", F.explode(F.array_distinct("participants"))).where(is_chat_id(F.col("user")))
    row = lambda part, note, days: [F.lit(part).alias("part"), "item", "headline", note.alias("note"), days.cast("long").alias("stale_days"), F.nullif("evidence_id", F.lit("")).alias("evidence_id")]
    none = F.lit(None)
    yesterday = each.where((now - F.col("last_ts")) / 86400.0 <= recent).select("user", *row("yesterday", F.col("evidence"), none))
    carried = each.where((F.col("state") != "done") & (F.col("age_days") > stale)).select("user", *row("carried", none.cast("string"), F.floor(F.col("age_days") + 0.5)))
    own = messages.select("item", F.col("id").alias("evidence_id"), "user", "text")
    blocked = each.where("state = 'blocked'").join(own, ["item", "evidence_id", "user"]).select("user", *row("blocked", stated_blocker(F.col("evidence"), F.col("text")), none))
    most = yesterday.unionByName(carried)
    return most.unionByName(blocked.join(most.select("user").distinct(), "user", "left_semi"))


def offered(lines: DataFrame) -> DataFrame:
    """(user, part, place, text): what the boxes of a draft begin with.

    done: yesterday's items, five at most. today: carried items, tickets before others and then the stalest, three at
    most; yesterday's, if nothing is carried. blocker: three at most, in the person's words, with the ticket's key.
    """
    ticket = F.col("item").rlike(rf"^{TICKET}$")
    text = F.when(ticket, F.concat_ws(" ", "item", "headline")).otherwise(F.col("headline"))
    place = lambda *order: F.row_number().over(Window.partitionBy("user").orderBy(*order, "item"))
    some = lambda part: lines.where(F.col("part") == part)
    done = some("yesterday").select("user", F.lit("done").alias("part"), place(F.lit(0)).alias("place"), text.alias("text")).where(F.col("place") <= MOST_DONE)
    today = some("carried").select("user", F.lit("today").alias("part"), place(F.desc(ticket), F.desc("stale_days")).alias("place"), text.alias("text"))
    instead = some("yesterday").join(today.select("user").distinct(), "user", "left_anti").select("user", F.lit("today").alias("part"), place(F.lit(0)).alias("place"), text.alias("text"))
    short = F.when(F.length("note") > BLOCKER, F.concat(F.left("note", F.lit(BLOCKER - 1)), F.lit("…"))).otherwise(F.col("note"))
    waits = F.concat(F.lit("Pending "), short, F.when(ticket, F.concat(F.lit(" ("), F.col("item"), F.lit(")"))).otherwise(""))
    blocker = some("blocked").select("user", F.lit("blocker").alias("part"), place(F.lit(0)).alias("place"), waits.alias("text"))
    return done.unionByName(today.unionByName(instead).unionByName(blocker).where(F.col("place") <= MOST_OFFERED))


# the next morning


def day_before(days: DataFrame, asked: DataFrame) -> DataFrame:
    """(date, previous): the last day on record before each asked date; null if there is none. days(date), asked(date)."""
    marks = days.select("date", F.lit(0).alias("ask")).distinct().unionByName(asked.select("date", F.lit(1).alias("ask")).distinct())
    line = Window.partitionBy(F.year("date")).orderBy("date", F.desc("ask"))
    within = marks.withColumn("year", F.year("date")).withColumn("previous", F.last(F.when(F.col("ask") == 0, F.col("date")), ignorenulls=True).over(line)).where("ask = 1")
    lasts = days.groupBy(F.year("date").alias("y")).agg(F.max("date").alias("end"))
    earlier = within.join(F.broadcast(lasts), F.col("y") < F.col("year"), "left").groupBy("date", "previous").agg(F.max("end").alias("end"))  # a row for each year
    return earlier.select("date", F.coalesce("previous", "end").alias("previous"))


def without_simulated(days: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Days and answers without what was made up for a demonstration: a simulated day without a post of its own goes whole.

    days(date, ts, simulated), answers(date, user, simulated).
    """
    seeded = F.coalesce("simulated", F.lit(False)) & (F.coalesce("ts", F.lit("")) == "")
    kept = days.where(~seeded)
    real = answers.where(~F.coalesce("simulated", F.lit(False))).join(kept.select("date"), "date", "left_semi")
    return kept.withColumn("simulated", F.lit(False)), real


def morning_post(days: DataFrame, answers: DataFrame, streaks: DataFrame, date: str, most: int = 5) -> DataFrame:
    """(place, user, blocker, days, previous, answered, more): what a day's first post repeats.

    The last day before and how many answered then, the blockers that came back most often, and how many more there
    are. Without any blocker one row has the day alone. days(date), answers(date, user), streaks(user, blocker, days).
    """
    today = days.sparkSession.range(1).select(F.lit(date).cast("date").alias("date"))
    previous = day_before(days, today).join(answers.groupBy(F.col("date").alias("previous")).agg(F.countDistinct("user").alias("answered")), "previous", "left").select("previous", F.coalesce("answered", F.lit(0)).alias("answered"))
    order = [F.desc("days"), "user", "blocker"]
    first = streaks.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    count = streaks.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
    return previous.crossJoin(F.broadcast(count)).join(F.broadcast(first), F.lit(True), "left").select("place", "user", "blocker", "days", "previous", "answered", "more")
