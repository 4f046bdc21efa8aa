"""Typed relations between pairs of messages, and links from messages to work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cues
from ..functions import text as T
from .signals import anchors

#: How sure each tier of linking is.
TIERS = {"override": 1.0, "explicit": 1.0, "thread": 0.9, "consensus": 0.75, "cluster": 0.5, "unassigned": 0.0}
#: The least size of a cluster that is a work item, and the share of its links that must agree.
CLUSTER, SHARE = 2, 0.5
#: Prefixes of standards, which look like keys of tickets.
STANDARDS = ["UTF", "ISO", "ASCII", "ANSI", "BASE", "SHA", "MD", "AES", "RSA", "HMAC", "RFC", "CVE", "ISBN", "IPV", "UTC", "GMT", "HTTP", "HTTPS", "TLS", "SSL", "GPT", "ES", "CSS", "HTML", "IEEE", "PCI", "SOC", "ARM", "X", "T", "COVID"]


def by_time(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs(l, r) -> (source, target): the earlier record first; where times are missing or equal, the lesser position.

    records: (id, ts, pos).
    """
    side = lambda s: records.select(F.col("id").alias(s), F.col("ts").alias(f"{s}_ts"), F.col("pos").alias(f"{s}_pos"))
    both = pairs.join(side("l"), "l").join(side("r"), "r")
    timed = F.col("l_ts").isNotNull() & F.col("r_ts").isNotNull() & (F.col("l_ts") != F.col("r_ts"))
    first = F.when(timed, F.col("l_ts") < F.col("r_ts")).otherwise(F.col("l_pos") <= F.col("r_pos"))
    rest = [c for c in pairs.columns if c not in ("l", "r")]
    return both.select(F.when(first, F.col("l")).otherwise(F.col("r")).alias("source"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("target"), *rest)


def read(records: DataFrame) -> DataFrame:
    """What typing needs of each record, computed once: (id, user, asked, whole, lines, all cues of each line, anchors).

    ``found`` holds for each type without a window its (line index, cue, line anchors) by line; ``opening`` the windowed
    types' first cue.
    """
    text = F.coalesce("text", F.lit(""))
    lines = T.asserted_lines(text)
    prepared = F.col("analysis_text") if "analysis_text" in records.columns else F.lit(None).cast("string")
    base = records.select("id", F.coalesce("user", F.lit("")).alias("user"), "ts", T.is_question(text).alias("asked"), T.for_analysis(prepared, text).alias("whole"), lines.alias("lines"), text.alias("text"))
    out = base.withColumn("own_anchors", anchors(F.col("whole")))
    for name, (_, window, some) in cues.RELATIONS.items():
        if window is None:
            out = out.withColumn(f"c_{name}", _first_line(some))
        else:
            out = out.withColumn(f"c_{name}", F.struct(T.first_cue(F.col("whole"), some, window).alias("cue"), F.lit(0).alias("at")))
    return out


def _first_line(some: list[str]) -> Column:
    """(cue, at) of the first line with one of these cues."""
    at = F.transform(F.transform("lines", lambda x: T.first_cue(x, some)), lambda c, i: F.struct(c.alias("cue"), i.alias("at")))
    return F.get(F.filter(at, lambda x: x["cue"].isNotNull()), F.lit(0))


def typed(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """pairs(source, target) -> with relation, score, evidence. prepared: read(records).

    The first type in order wins. A cue below a post's first line counts only if that line, or the post's opening,
    points at the earlier message: by a shared anchor, or by naming its author.
    """
    need = ["id", "user", "asked", "lines", "own_anchors", *[f"c_{n}" for n in cues.RELATIONS]]
    later = prepared.select(F.col("id").alias("target"), *[F.col(c).alias(f"t_{c}") for c in need[3:]])
    earlier = prepared.select(F.col("id").alias("source"), F.col("user").alias("s_user"), F.col("asked").alias("s_asked"), F.col("own_anchors").alias("s_anchors"))
    both = pairs.join(earlier, "source").join(later, "target")
    tests = []
    for name, (confidence, window, _) in cues.RELATIONS.items():
        hit = F.col(f"t_c_{name}")
        made = F.struct(F.lit(name).alias("relation"), F.lit(confidence).alias("score"), F.concat(F.lit("cue "), hit["cue"]).alias("evidence"))
        if window is not None:
            ok = hit["cue"].isNotNull() & (F.col("s_asked") if name == "answers" else F.lit(True))
        else:
            line = F.get("t_lines", hit["at"])
            shared = F.size(F.array_intersect(anchors(line), F.col("s_anchors"))) > 0
            named = (F.col("s_user") != "") & (line.contains(F.col("s_user")) | F.get("t_lines", F.lit(0)).contains(F.col("s_user")))
            ok = hit["cue"].isNotNull() & ((hit["at"] == 0) | shared | named)
        tests.append(F.when(ok, made))
    none = F.struct(F.lit(cues.UNTYPED).alias("relation"), F.lit(cues.UNTYPED_CONFIDENCE).alias("score"), F.lit("no cue").alias("evidence"))
    return both.withColumn("__t", F.coalesce(*tests, none)).select(*pairs.columns, "__t.*")


# links


def trusted_prefixes(records: DataFrame, configured: list[str] | None = None) -> DataFrame:
    """(prefix): the configured ones; else those with several keys, or of three letters, that are no standards."""
    if configured:
        return records.sparkSession.createDataFrame([(p.strip().upper(),) for p in configured if p.strip()], "prefix string")
    keys = records.select(F.explode(T.ticket_keys(F.coalesce("text", F.lit("")))).alias("key")).distinct()
    seen = keys.groupBy(T.prefix(F.col("key")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return seen.where(((F.col("n") > 1) | (F.length("prefix") >= 3)) & ~F.col("prefix").isin(STANDARDS)).select("prefix")


def explicit(records: DataFrame, trusted: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """(id, key): the ticket each message is about: its channel's own project first, then the most mentioned, then the first named."""
    named = records.select("id", "channel_id", F.posexplode(T.ticket_keys(F.coalesce("text", F.lit("")))).alias("pos", "ticket")).withColumn("prefix", T.prefix(F.col("ticket"))).join(trusted, "prefix")
    counts = named.groupBy("ticket").agg(F.count(F.lit(1)).alias("n"))
    known = named.join(counts, "ticket")
    own = F.lit(0)
    if projects is not None:
        known = known.join(projects.select("channel_id", F.upper("project").alias("project")), "channel_id", "left")
        own = F.coalesce((F.col("project") == F.col("prefix")).cast("int"), F.lit(0))
    return known.groupBy("id").agg(F.max_by("ticket", F.struct(own.alias("own"), F.col("n"), -F.col("pos"))).alias("ticket")).select("id", F.concat(F.lit("ticket:"), "ticket").alias("key"))


def _vote(members: DataFrame, by: str) -> DataFrame:
    """(by, key, votes, linked): the most common key of a group, ties to the one that came first."""
    counted = members.groupBy(by, "key").agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("first"))
    linked = counted.groupBy(by).agg(F.sum("votes").alias("linked"), F.max(F.struct(F.col("votes"), (-F.col("first")).alias("f"), "key")).alias("b"))
    return linked.select(by, "linked", F.col("b.key").alias("key"), F.col("b.votes").alias("votes"))


def link(records: DataFrame, clusters: DataFrame | None = None, overrides: DataFrame | None = None, configured: list[str] | None = None, projects: DataFrame | None = None, own_key: str | None = None) -> DataFrame:
    """(id, key, tier, confidence): each record's work item by the first tier that knows one; people's overrides win.

    records(id, pos, thread_ts, channel_id, text), clusters(id, label), overrides(id, key), where an empty key unlinks.
    """
    trusted = trusted_prefixes(records, configured)
    base = records.select("id", "pos", F.when(~F.coalesce("thread_ts", F.lit("")).isin("", "None", "nan"), F.col("thread_ts")).alias("thread"), *([F.col(own_key).alias("own")] if own_key else []))
    step = base.join(explicit(records, trusted, projects), "id", "left")
    if own_key:
        step = step.withColumn("key", F.coalesce(F.concat(F.lit("ticket:"), F.upper(F.nullif(F.trim("own"), F.lit("")))), F.col("key")))
    step = step.withColumn("tier", F.when(F.col("key").isNotNull(), "explicit"))
    voted = _vote(step.where("key is not null and thread is not null"), "thread").select("thread", F.col("key").alias("tk"))
    step = step.join(voted, "thread", "left").withColumn("tier", F.when(F.col("tier").isNull() & F.col("tk").isNotNull(), "thread").otherwise(F.col("tier"))).withColumn("key", F.coalesce("key", "tk")).drop("tk")
    if clusters is not None:
        sized = clusters.join(clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "label")
        step = step.join(sized, "id", "left")
        agreed = _vote(step.where("label is not null and key is not null"), "label").where((F.col("linked") >= 2) & (F.col("votes") / F.col("linked") >= SHARE)).select("label", F.col("key").alias("ck"))
        step = step.join(agreed, "label", "left")
        big = F.col("tier").isNull() & (F.col("size") >= CLUSTER)
        step = step.withColumn("tier", F.when(big & F.col("ck").isNotNull(), "consensus").when(big, "cluster").otherwise(F.col("tier")))
        step = step.withColumn("key", F.when(F.col("tier") == "consensus", F.col("ck")).when(F.col("tier") == "cluster", F.concat(F.lit("cluster:"), F.col("label").cast("string"))).otherwise(F.col("key")))
    if overrides is not None:
        step = step.join(overrides.select("id", F.col("key").alias("ok")), "id", "left")
        step = step.withColumn("tier", F.when(F.col("ok") == "", "unassigned").when(F.col("ok").isNotNull(), "override").otherwise(F.col("tier"))).withColumn("key", F.coalesce("ok", "key"))
    tier = F.coalesce("tier", F.lit("unassigned"))
    sure = F.coalesce(*[F.when(tier == t, F.lit(c)) for t, c in TIERS.items()])
    return step.select("id", F.coalesce("key", F.lit("")).alias("key"), tier.alias("tier"), sure.alias("confidence"))


def last_overrides(events: DataFrame, order: str = "pos") -> DataFrame:
    """The last row of each record, from a log of overrides; rows without an id don't count."""
    return events.where("id is not null and id != ''").groupBy("id").agg(F.max_by("key", order).alias("key"))


def unresolved(overrides: DataFrame, records: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(id, key, cause): overrides of records that aren't there, because their channel is skipped or at all."""
    lost = overrides.join(records.select("id"), "id", "left_anti")
    if skipped is None:
        return lost.withColumn("cause", F.lit("missing"))
    return lost.join(skipped.select("id").withColumn("s", F.lit(True)), "id", "left").withColumn("cause", F.when(F.col("s"), "skipped channel").otherwise("missing")).drop("s")


def content_ids(records: DataFrame, by: str = "topic") -> DataFrame:
    """(topic, content_id): named after the earliest record, records without a time last."""
    first = F.min_by("id", F.struct(F.coalesce("ts", F.lit(float("inf"))).alias("ts"), "id"))
    return records.groupBy(by).agg(T.content_id(first).alias("content_id"))


def item_ids(records: DataFrame, links: DataFrame, by: str = "topic") -> DataFrame:
    """(topic, item_id, ticket_votes): the ticket most of a topic's messages have, if no other topic has more of it; else its content id.

    records(id, ts, topic). Of topics with as many votes the earliest owns the ticket.
    """
    votes = records.join(links.where(F.col("key").startswith("ticket:")), "id").groupBy(by, "key").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    best = votes.groupBy(by).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "key")).alias("b")).select(by, F.col("b.n").alias("n"), F.col("b.key").alias("key"))
    begun = records.groupBy(by).agg(F.min(F.struct(F.coalesce("ts", F.lit(float("inf"))), "id")).alias("begun"))
    claim = best.join(begun, by)
    order = Window.partitionBy("key").orderBy(F.desc("n"), "begun", by)
    owned = claim.withColumn("r", F.row_number().over(order)).where("r = 1").select(by, F.substring("key", 8, 1 << 20).alias("ticket"), F.col("n").alias("ticket_votes"))
    return content_ids(records, by).join(owned, by, "left").select(by, F.coalesce("ticket", "content_id").alias("item_id"), F.coalesce("ticket_votes", F.lit(0)).cast("bigint").alias("ticket_votes"))


def strong(relations: DataFrame, least: float) -> DataFrame:
    """Relations of at least a score: the highest first, and then by name."""
    return relations.where(F.col("score") >= least).orderBy(F.desc("score"), "relation", "source", "target")
