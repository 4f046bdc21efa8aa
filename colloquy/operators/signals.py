"""Structural signals: anchors, pair signals, edges, and measures of communities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.when import nearness
from .graphs import written
from .lexical import idf

#: Weights of an edge's signals, and the least weight that is kept.
DENSE, THREAD, TIME, ANCHORS, MEETING_THREAD, CHANNEL, LEAST = 1.0, 1.5, 0.3, 0.8, 0.25, 0.35, 0.05

#: Shapes of anchors, by kind; the group that holds the anchor.
KINDS: list[tuple[str, str, int]] = [
    ("ticket", r"\b[A-Z][A-Z0-9]{1,9}-\d{1,6}\b", 0),
    ("version", r"\bv?\d+\.\d+(?:\.\d+)?\b", 0),
    ("path", r"\b[\w./-]+\.(?:py|ts|tsx|js|jsx|json|ya?ml|sql|md|tf|sh|kt|swift|java|go|rb)\b", 0),
    ("url", r'(?i)\bhttps?://[^\s<>"]+|\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|co|dev|app|ai)\b', 0),
    ("identifier", r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b|\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", 0),
    ("acronym", r"\b[A-Z]{3,6}\b", 0),
    ("money", r"[$€£฿]\s?[\d,]+(?:\.\d+)?\s?[kKmM]?\b", 0),
    ("quoted", r"[\"‘’“”*]([A-Za-z][\w .,&'-]{2,48}?)[\"‘’“”*]", 1),
    ("quoted", r"(?<![A-Za-z])'([A-Za-z][\w .,&-]{2,48}?)'(?![A-Za-z])", 1),
]
PROPER = r"\b[A-Z][a-z]{2,}(?:[ ]+[A-Z][a-z]{2,}){0,2}\b"
#: Characters after which a capital says nothing.
SENTENCE_MARKS = ".!?:;\n\r*•|-–—([{\"'“‘>"
#: Words that are no anchors by themselves.
COMMON = [
    "the", "this", "that", "team", "hey", "hi", "hello", "thanks", "please", "just", "also", "any", "all", "and", "but", "for", "from", "with", "have", "has", "will", "can", "could", "would", "should", "here", "there", "what", "when", "where", "which", "who", "why", "how",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "today", "tomorrow", "yesterday", "update", "updates", "summary", "note", "notes", "thread", "channel", "message",
]


def anchors(text: Column, kinds: list[str] | None = None) -> Column:
    """Concrete strings that tie a message to a work item: lower-cased, once each.

    A single capitalised word counts only within a sentence, which one pattern with a bounded look back decides.
    """
    wanted = [(p, g) for k, p, g in KINDS if kinds is None or k in kinds]
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in wanted]
    if kinds is None or "proper" in kinds:
        marks = "".join("\\" + c if c in r"\.^$|?*+()[]{}-" else c for c in SENTENCE_MARKS)
        found.append(F.filter(F.regexp_extract_all(text, F.lit(PROPER), F.lit(0)), lambda x: x.contains(" ")))
        # a word of its own: something other than a sentence's beginning, then blanks, then the word
        alone = rf"(?<=[^{marks} \t][ \t]{{0,6}}){PROPER}"
        found.append(F.filter(F.regexp_extract_all(text, F.lit(alone), F.lit(0)), lambda x: ~x.contains(" ")))
    cleaned = F.transform(F.concat(*found), lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))))
    common = F.array(*map(F.lit, COMMON))
    return F.array_distinct(F.filter(cleaned, lambda x: (F.length(x) >= 3) & (F.size(F.array_except(F.split(x, " "), common)) > 0)))


def anchor_table(records: DataFrame, key: str = "id", text: str = "text", kinds: list[str] | None = None) -> DataFrame:
    return records.select(F.col(key).alias("id"), F.explode(anchors(F.col(text), kinds)).alias("anchor"))


def anchor_idf(table: DataFrame, n: int) -> DataFrame:
    """(anchor, df, idf) over n records."""
    return table.groupBy("anchor").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(F.lit(n), F.col("df")))


#: Tasks that a result with a row for each pair is dealt over, and ids of a class that go through the join together.
PAIR_TASKS, PAIR_IDS = 96, 1024


def anchor_overlap(table: DataFrame, idfs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score): the share of a query's anchor weight that a record has too. asked(query_id, anchor).

    Records of equal anchors are one class, and so are queries: only classes are compared, and a row for each pair comes
    from a join of a query with blocks of ids, so that none is shuffled. A class's blocks are dealt by query and block.
    """
    sets = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_set("anchor")).alias("set"))
    mine, theirs = written(sets(table, "id")), written(sets(asked, "query_id"))
    classes, kinds = (df.select("set").distinct().select("set", F.explode("set").alias("anchor")) for df in (mine, theirs))
    weighted = kinds.withColumnRenamed("set", "asks").join(idfs.select("anchor", "idf"), "anchor")
    whole = weighted.groupBy("asks").agg(F.sum("idf").alias("whole")).where("whole > 0")
    shared = classes.join(weighted, "anchor").groupBy("asks", "set").agg(F.sum("idf").alias("s"))
    met = shared.join(whole, "asks").select("asks", "set", (F.col("s") / F.col("whole")).alias("score"))
    size = mine.groupBy("set").agg(F.count(F.lit(1)).alias("size"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PAIR_IDS)).cast("int")
    blocks = mine.join(size, "set").groupBy("set", part.alias("block")).agg(F.collect_list("id").alias("ids"))
    each = theirs.withColumnRenamed("set", "asks").join(met, "asks").join(blocks.select("set", "block").distinct(), "set").select("query_id", "set", "block", "score")
    dealt = each.repartition(PAIR_TASKS, "query_id", "block")
    return dealt.join(blocks, ["set", "block"]).select("query_id", F.explode("ids").alias("id"), "score")


def anchor_shares(idfs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, anchor, share): of each anchor in its query's whole anchor weight, which a record that has it scores in anchor_overlap()."""
    weighted = asked.join(idfs.select("anchor", "idf"), "anchor")
    whole = weighted.groupBy("query_id").agg(F.sum("idf").alias("whole")).where("whole > 0")
    return weighted.join(whole, "query_id").select("query_id", "anchor", (F.col("idf") / F.col("whole")).alias("share"))


def pair_signals(pairs: DataFrame, records: DataFrame, table: DataFrame, idfs: DataFrame) -> DataFrame:
    """pairs(l, r) with thread, time, user, channel and anchors (twice the shared weight over both weights)."""
    facts = records.select("id", "ts", "thread_ts", "user", "channel_id")
    sides = [facts.select(*[F.col(c).alias(f"{s}_{c}" if c != "id" else s) for c in facts.columns]) for s in ("l", "r")]
    both = pairs.join(sides[0], "l").join(sides[1], "r")
    same = lambda c: (F.coalesce(F.col(f"l_{c}"), F.lit("")) == F.coalesce(F.col(f"r_{c}"), F.lit(""))) & (F.coalesce(F.col(f"l_{c}"), F.lit("")) != "")
    weighted = table.join(idfs.select("anchor", "idf"), "anchor")
    weight = weighted.groupBy("id").agg(F.sum("idf").alias("w"))
    shared = pairs.join(weighted.select(F.col("id").alias("l"), "anchor", "idf"), "l").join(table.select(F.col("id").alias("r"), "anchor"), ["r", "anchor"]).groupBy("l", "r").agg(F.sum("idf").alias("s"))
    out = both.join(weight.withColumnsRenamed({"id": "l", "w": "wl"}), "l", "left").join(weight.withColumnsRenamed({"id": "r", "w": "wr"}), "r", "left").join(shared, ["l", "r"], "left")
    total = F.coalesce("wl", F.lit(0.0)) + F.coalesce("wr", F.lit(0.0))
    return out.select(
        *pairs.columns,
        same("thread_ts").cast("double").alias("thread"),
        nearness(F.col("l_ts"), F.col("r_ts")).alias("time"),
        same("user").cast("double").alias("user"),
        same("channel_id").cast("double").alias("channel"),
        F.when(total > 0, 2 * F.coalesce("s", F.lit(0.0)) / total).otherwise(F.lit(0.0)).alias("anchors"),
    )


def thread_pairs(records: DataFrame) -> DataFrame:
    """(l, r) of records of a thread, the earlier id first; meetings pair no one."""
    some = records.where("source != 'meeting' and coalesce(thread_ts, '') != ''").select("id", "thread_ts")
    return some.alias("a").join(some.alias("b"), "thread_ts").where("a.id < b.id").select(F.col("a.id").alias("l"), F.col("b.id").alias("r"))


def edges(signals: DataFrame) -> DataFrame:
    """Pair signals with dense similarity -> weighted edges, the weak ones dropped."""
    weight = DENSE * F.greatest(F.coalesce("dense", F.lit(0.0)), F.lit(0.0)) + THREAD * F.col("thread") + TIME * F.col("time") + ANCHORS * F.col("anchors") + CHANNEL * F.col("channel")
    return signals.withColumn("weight", weight).where(F.col("weight") >= LEAST)


def rescued(nodes: DataFrame, graph: DataFrame, nearest: DataFrame) -> DataFrame:
    """(l, r, weight) for nodes without an edge: to the one most like it, at max(0.05, similarity). nearest(l, r, sim, rank)."""
    linked = graph.select(F.col("l").alias("id")).unionByName(graph.select(F.col("r").alias("id"))).distinct()
    alone = nodes.join(linked, "id", "left_anti")
    return nearest.where("rank = 1").join(alone.select(F.col("id").alias("l")), "l", "left_semi").select("l", "r", F.greatest(F.col("sim"), F.lit(LEAST)).alias("weight"))


# measures of communities


def size_ranked(found: DataFrame) -> DataFrame:
    """Communities numbered by size, the largest first, ties to the least member."""
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    order = Window.orderBy(F.desc("size"), "least")
    return found.join(sizes.withColumn("label", F.row_number().over(order) - 1), "community").select("id", "label", "size")


def modularity(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels(id, label) at resolution 1."""
    a = graph.join(labels.select(F.col("id").alias("l"), F.col("label").alias("cl")), "l").join(labels.select(F.col("id").alias("r"), F.col("label").alias("cr")), "r")
    both = a.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("cl") == F.col("cr"), F.col("weight")).otherwise(0.0)).alias("within"))
    ends = a.select(F.col("cl").alias("c"), "weight").unionByName(a.select(F.col("cr").alias("c"), "weight"))
    squares = ends.groupBy("c").agg(F.sum("weight").alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return both.crossJoin(squares).select((F.col("within") / F.col("m") - F.col("dd") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def agreement(labels: DataFrame, a: str = "label", b: str = "truth") -> DataFrame:
    """One row: adjusted Rand index, and mutual information over the mean of the entropies."""
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    rows = cells.groupBy(a).agg(F.sum("n").alias("x"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("y"))
    total = labels.agg(F.count(F.lit(1)).cast("double").alias("t"))
    sums = cells.agg(pairs(F.col("n")).alias("both")).crossJoin(rows.agg(pairs(F.col("x")).alias("sa"))).crossJoin(cols.agg(pairs(F.col("y")).alias("sb"))).crossJoin(total)
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    most = (F.col("sa") + F.col("sb")) / 2
    entropy = lambda df, c: df.crossJoin(total).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias("h" + c))
    shared = cells.join(rows, a).join(cols, b).crossJoin(total)
    mutual = shared.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("y")))).alias("mi"))
    out = sums.crossJoin(mutual).crossJoin(entropy(rows, "x")).crossJoin(entropy(cols, "y"))
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / (most - expected))
    nmi = F.when(F.col("hx") + F.col("hy") == 0, F.lit(1.0)).otherwise(2 * F.col("mi") / (F.col("hx") + F.col("hy")))
    return out.select(ari.alias("ari"), nmi.alias("nmi"))


def purity(labels: DataFrame, group: str = "label", truth: str = "truth") -> DataFrame:
    """(group, size, purity): the largest share of one truth in each group."""
    cells = labels.groupBy(group, truth).agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy(group).agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("purity"))


def cluster_labels(table: DataFrame, idfs: DataFrame, labels: DataFrame, most: int = 3) -> DataFrame:
    """(label, name): the most telling anchors of each cluster, readable ones first."""
    readable = ~F.col("anchor").rlike(r"[.]|://|^\d+$") & (F.length("anchor") < 24)
    counted = table.join(labels, "id").groupBy("label", "anchor").agg(F.count(F.lit(1)).alias("n")).join(idfs.select("anchor", "idf"), "anchor")
    order = Window.partitionBy("label").orderBy(F.desc(readable), F.desc(F.round(F.col("n") * F.col("idf"), 9)), F.desc("anchor"))
    best = counted.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return best.groupBy("label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "anchor"))), lambda x: x["anchor"]), ", ").alias("name"))
