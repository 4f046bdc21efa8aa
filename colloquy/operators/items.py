"""Work items as their readers meet them: names, states and order, and which items, people and messages a request means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TICKET, collapse

#: Days of quiet after which an item stalls, and the order of the four states.
STALE_DAYS, STATES = 3.0, ["blocked", "stalled", "moving", "done"]
#: Fixed value: how a written headline ends by saying the state again.
STATE_CLAUSE = r" — (?:ติดอยู่ ยังไปต่อไม่ได้|blocked — not moving|ปิดแล้ว|resolved|กำลังดำเนินอยู่|in progress)$"
#: What is said where nothing changed an item's state, and where it has no headline.
NO_CHANGE, NO_HEADLINE = "ยังไม่มีสัญญาณเปลี่ยนสถานะ — ล่าสุด ", "(ไม่มีหัวข้อ)"
#: Beginnings of a message that is politeness and no title.
PLEASANTRIES = ["ขอบคุณ", "โอเค", "ok", "okay", "thanks", "thank you", "ครับ", "ค่ะ", "จ้า", "noted", "รับทราบ", "+1"]
#: Characters of a title, the least that carry a subject, and below which politeness is all of it.
TITLE, SUBJECT, POLITE = 90, 18, 40
#: Sources that a record may name, and the blocks of one post.
SOURCES, BLOCKS = ["slack", "slack_paste", "meeting", "note", "youtrack", "notion"], 47
#: Fixed value: what a number stands after in the key of an item without a ticket.
UNNAMED = "TAM"
MESSAGE_ID = r"^msg_([A-Z0-9]+)_(\d+\.\d+)$"


# states and order


def bot_state(state: Column, quiet_days: Column, stale: float = STALE_DAYS) -> Column:
    """Blocked and done as they were inferred; what is neither is stalled after some days of quiet, else moving."""
    return F.when(state == "blocked", "blocked").when(state == "resolved", "done").when(quiet_days > stale, "stalled").otherwise("moving")


def state_place(state: Column, order: list[str] = STATES) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), state)


def board_order(state: Column, age: Column) -> list[Column]:
    """Blocked, stalled, moving, done; within a state the oldest first."""
    return [state_place(state), F.desc_nulls_last(age)]


def list_order(by: str, place: str = "place", age: str = "age", last: str = "last", size: str = "size") -> list[Column]:
    """The orders that a reader may choose: urgency, age, recent, size. A missing age or time counts as 0."""
    down = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0)))
    return {"urgency": [F.asc(place)], "age": [down(age)], "recent": [down(last)], "size": [down(size)]}[by]


def filtered(items: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Items that have the words in any of the columns, whatever the case."""
    return items.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted.strip().lower())))


def trimmed(blocks: DataFrame, order: list[Column], most: int = BLOCKS) -> DataFrame:
    """The first blocks of a post, with how many were left out; one more than fits is shown whole."""
    count = blocks.agg(F.count(F.lit(1)).alias("all"))
    first = blocks.orderBy(*order).limit(most + 1)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(count))
    return placed.where((F.col("place") <= most) | (F.col("all") <= most + 1)).withColumn("omitted", F.when(F.col("all") > most + 1, F.col("all") - most).otherwise(0)).drop("all")


# names of items


def newest(messages: DataFrame) -> DataFrame:
    """(item, newest): the latest message by time, the first of equals; by position, if any message has no time."""
    timed = F.count("ts") == F.count(F.lit(1))
    return messages.groupBy("item").agg(F.when(timed, F.max_by("id", F.struct("ts", -F.col("pos")))).otherwise(F.max_by("id", "pos")).alias("newest"))


def headlines(messages: DataFrame) -> DataFrame:
    """(item, headline): the first line of the longest of the first three messages, cut to 90 characters."""
    nth = F.row_number().over(Window.partitionBy("item").orderBy("pos"))
    first = messages.withColumn("nth", nth).where("nth <= 3").groupBy("item").agg(F.max_by("text", F.struct(F.length("text"), -F.col("nth"))).alias("text"))
    line = F.substring_index("text", "\n", 1)
    return first.select("item", F.when(F.length(line) > TITLE, F.concat(F.left(line, F.lit(TITLE - 2)), F.lit("…"))).when(line == "", NO_HEADLINE).otherwise(line).alias("headline"))


def written_headline(written: Column, label: Column) -> Column:
    """A summary's headline without the state that it ends with; the label, if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(F.coalesce(written, F.lit(""))), STATE_CLAUSE, "")), F.lit("")), label)


def work_items(topics: DataFrame, messages: DataFrame, now: Column, stale: float = STALE_DAYS) -> DataFrame:
    """(item, headline, state, evidence, evidence_id, age_days): topics as items of the board.

    topics(item, label, headline, state, evidence, evidence_id, age_days, last_ts), messages(item, id, pos, ts, shown).
    Where no change of state is the evidence, the newest message is, and says so.
    """
    last = newest(messages).join(messages.select("item", F.col("id").alias("newest"), "shown"), ["item", "newest"])
    both = topics.join(last, "item", "left")
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    said = F.coalesce(blank("evidence"), F.concat(F.lit(NO_CHANGE), F.col("shown")), F.lit(""))
    state = bot_state(F.col("state"), (now - F.col("last_ts")) / 86400.0, stale)
    return both.select("item", written_headline(F.col("headline"), F.col("label")).alias("headline"), state.alias("state"), said.alias("evidence"), F.coalesce(blank("evidence_id"), "newest", F.lit("")).alias("evidence_id"), F.round("age_days", 1).alias("age_days"))


def card_titles(topics: DataFrame, records: DataFrame) -> DataFrame:
    """(topic, title): a model's headline, else the ticket's own title, else the first line that a person wrote, else the label.

    topics(topic, item_id, label, headline: null without a model), records(topic, id, ts, source, text, ticket).
    """
    flat = collapse(F.coalesce(F.col("text"), F.lit("")))
    line = F.when(F.length(flat) > TITLE, F.concat(F.left(flat, F.lit(TITLE - 1)), F.lit("…"))).otherwise(flat)
    written = records.where("coalesce(source, 'slack') != 'youtrack'").select("topic", "ts", "id", line.alias("line"))
    low = F.lower(F.trim("line"))
    polite = F.lit(False)
    for word in PLEASANTRIES:
        polite = polite | (low.startswith(word) & (F.length(low) < POLITE))
    titled = (F.length(low) >= SUBJECT) & ~polite
    when = F.struct(F.coalesce("ts", F.lit(float("inf"))), "id")
    human = written.groupBy("topic").agg(F.coalesce(F.min_by(F.when(titled, F.col("line")), F.when(titled, when)), F.max_by("line", F.struct(F.length("line"), -F.coalesce("ts", F.lit(float("inf")))))).alias("human"))
    own = records.alias("r").join(topics.select("topic", F.upper("item_id").alias("k")).alias("t"), "topic").where("upper(r.ticket) = t.k")
    first = F.trim(F.substring_index(F.trim("text"), "\n", 1))
    ticket = own.where(first != "").groupBy("topic").agg(F.min_by(F.left(first, F.lit(110)), "id").alias("ticket_title"))
    both = topics.join(ticket, "topic", "left").join(human, "topic", "left")
    named = F.when(F.col("ticket_title").isNotNull(), F.when(F.col("item_id").startswith("c"), F.col("ticket_title")).otherwise(F.concat_ws(" · ", "item_id", "ticket_title")))
    return both.select("topic", F.coalesce(F.nullif("headline", F.lit("")), named, F.nullif("human", F.lit("")), "label").alias("title"))


# what a request means


def items_named(items: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, item): items whose id is a word of the query; else the one item that a number alone can mean.

    items(item), queries(query_id, text).
    """
    words = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("text"), F.lit(r"[A-Z0-9][A-Z0-9\-]*"), F.lit(0)))).alias("word"))
    known = items.select("item", F.upper("item").alias("word"))
    whole = words.join(known, "word").select("query_id", "item")
    number = known.select("item", F.regexp_extract("word", r"-(\d+)$", 1).alias("word")).where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("item")).where("n = 1")
    single = words.where(F.col("word").rlike(r"^\d+$")).join(number, "word").groupBy("query_id").agg(F.min_by("item", "word").alias("item"))
    return whole.unionByName(single.join(whole.select("query_id").distinct(), "query_id", "left_anti"))


def people_named(people: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, user): a participant by id, or else by display name in any case, the least id of equals. people(user, name)."""
    trimmed_ = asked.select("asked", F.trim("asked").alias("k")).distinct()
    by_id = trimmed_.join(people.select(F.col("user").alias("k"), "user"), "k").select("asked", "user", F.lit(0).alias("tier"))
    shown = F.lower(F.coalesce(F.nullif("name", F.lit("")), "user"))
    by_name = trimmed_.withColumn("k", F.lower("k")).join(people.select(shown.alias("k"), "user"), "k").select("asked", "user", F.lit(1).alias("tier"))
    return by_id.unionByName(by_name).groupBy("asked").agg(F.min(F.struct("tier", "user")).alias("x")).select("asked", "x.user")


def items_of_person(items: DataFrame, names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, item): items that aren't done which a person is assigned to or takes part in; a person by id or shown name.

    items(item, state, assignee, participants), names(user, name), asked(asked).
    """
    wanted = asked.select("asked", F.regexp_replace(F.lower("asked"), "^@", "").alias("k"))
    each = items.where("state != 'done'").select("item", F.explode(F.array_distinct(F.concat(F.array("assignee"), F.coalesce("participants", F.array().cast("array<string>"))))).alias("user")).where("user is not null")
    spelled = each.join(names, "user", "left").select("item", F.explode(F.array_distinct(F.array_compact(F.array(F.lower("user"), F.lower("name"))))).alias("k"))
    return wanted.join(spelled, "k").select("asked", "item").distinct()


def strays(overrides: DataFrame, members: DataFrame, records: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, id, elsewhere): records that a person linked to a topic's ticket and that stand in another topic, or in none.

    overrides(id, key), members(topic, id), records(id), topics(topic, item_id).
    """
    linked = overrides.select("id", F.upper(item_key(F.col("key"))).alias("k")).join(topics.select("topic", F.upper("item_id").alias("k")).where("k != ''"), "k")
    home = members.select("id", F.col("topic").alias("home")).join(topics.select(F.col("topic").alias("home"), F.col("item_id").alias("elsewhere")), "home")
    found = linked.join(records.select("id").distinct(), "id", "left_semi").join(home, "id", "left")
    return found.where("home is null or home != topic").select("topic", "id", F.coalesce("elsewhere", F.lit("")).alias("elsewhere"))


def owners(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits with the topic that each belongs to, the last one by order if several have it. members(id, topic, place)."""
    home = members.groupBy("id").agg(F.max_by("topic", "place").alias("topic"))
    return hits.join(home, "id", "left")


def found_by_link(hits: DataFrame, links: DataFrame) -> DataFrame:
    """Hits with linked: the key that a person linked a message to, where the message doesn't have it. hits(id, text), links(id, key)."""
    both = hits.join(links.select("id", "key"), "id", "left")
    absent = (F.coalesce("key", F.lit("")) != "") & ~F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("key"))
    return both.withColumn("linked", F.when(absent, F.col("key"))).drop("key")


def resolvable(drifts: DataFrame, items: DataFrame, messages: DataFrame) -> DataFrame:
    """Drifts whose item and message are both known. drifts(item, trigger), items(item), messages(id)."""
    known = items.select(F.upper("item").alias("__k")).distinct()
    ids = messages.select(F.col("id").alias("trigger")).distinct()
    return drifts.withColumn("__k", F.upper("item")).join(known, "__k", "left_semi").drop("__k").join(ids, "trigger", "left_semi")


# ids and keys


def is_chat_id(value: Column) -> Column:
    """Whether a name is a person's or bot's id of the chat: eight characters or more, U, W or B first, in capitals."""
    return value.rlike(r"^[UWB][A-Z0-9_]{7,}$") & value.rlike(r"^._*[A-Z0-9]")


def permalink(id_: Column, workspace: str) -> Column:
    """Where a chat message can be read; null for records that are none."""
    channel, at = F.regexp_extract(id_, MESSAGE_ID, 1), F.regexp_extract(id_, MESSAGE_ID, 2)
    return F.when(channel != "", F.concat(F.lit(f"{workspace}/archives/"), channel, F.lit("/p"), F.replace(at, F.lit("."), F.lit(""))))


def channel_of(id_: Column) -> Column:
    return F.nullif(F.regexp_extract(id_, MESSAGE_ID, 1), F.lit(""))


def source_of(id_: Column, given: Column) -> Column:
    """The source that a record names, if it is known; else what its id begins with says."""
    return F.when(given.isin(SOURCES), given).when(id_.startswith("mtg_"), "meeting").when(id_.startswith("paste_"), "slack_paste").otherwise("slack")


def linker_key(key: Column) -> Column:
    """A key as the linker has it: empty to unlink, as it is with a namespace, cluster:n or ticket:KEY; null if it is none."""
    k, up = F.trim(key), F.upper(F.trim(key))
    topic = F.regexp_extract(up, rf"^{UNNAMED}-(\d+)$", 1)
    return F.when(k == "", "").when(k.contains(":"), k).when(topic != "", F.concat(F.lit("cluster:"), topic)).when(up.rlike(rf"^{TICKET}$"), F.concat(F.lit("ticket:"), up))


def item_key(key: Column) -> Column:
    """The item's id of any spelling of its key."""
    return F.trim(F.regexp_replace(key, "(?i)^ticket:", ""))


def stated_blocker(evidence: Column, said: Column) -> Column:
    """What blocks, in words: the passage that the evidence quotes, else the message's first line with words."""
    quoted = F.regexp_extract(evidence, r'[“"]([^”"]{4,})[”"]', 1)
    lines = F.filter(F.transform(F.split(said, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(quoted != "", F.trim(quoted)).otherwise(F.coalesce(F.get(lines, F.lit(0)), F.trim(said)))


def cue_inside(text: Column, cues: list[str]) -> Column:
    """The first cue, in list order, that the text has anywhere, whatever the case; null if none."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(c.lower())), F.lit(c)) for c in cues])
