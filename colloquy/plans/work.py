"""Work-item queries over the driver's tables, each with its SQL: text, relations, links, state, drift, people, dailies.

Events stand for a person's work: an error blocks, a purchase resolves, the rest is movement. Orders stand for tickets,
line items for messages that name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cues, when
from ..functions import text as T
from ..operators import decisions, drift, louvain, relations, signals, state, upserts
from ..operators.graphs import components, written
from ..sources import records as R
from ..sources.tables import conversation_records, table
from .search import RECORDS

#: "Now" of all queries that need one: the end of the events.
NOW = "2024-01-31"


# text


def normalize_markup(spark: SparkSession, d: str) -> DataFrame:
    """Pages as messages that hold a link to them and a mention."""
    p = table(spark, d, "pages").where("url is not null")
    text = F.concat(F.lit("see <"), F.col("url"), F.lit("|page "), F.col("page_id").cast("string"), F.lit("> and <"), F.col("url"), F.lit(">  from <@U"), F.col("page_id").cast("string"), F.lit("> :tada:\r\n\r\n&lt;ok&gt; "))
    return p.select("page_id", T.normalize(text).alias("plain"), F.array_join(T.mentions(text), ",").alias("people"))


def usefulness_filter(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns that say something."""
    c = table(spark, d, "conversations").withColumn("text", F.when(F.pmod("conv_id", F.lit(7)) == 0, "ok thanks!!").when(F.pmod("conv_id", F.lit(7)) == 1, "555").when(F.pmod("conv_id", F.lit(7)) == 2, "ok, merged").otherwise(F.col("text")))
    return c.where(T.is_useful(F.col("text"))).select("conv_id", "turn")


def asserted_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    noisy = F.concat(F.lit("> quoted line\n"), F.col("text"), F.lit("\n~struck out~ kept `code` end\n```\nfenced\n```"))
    lines = docs.select("doc_id", T.asserted_lines(noisy).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("n"), F.sha1(F.array_join("lines", " ").cast("binary")).alias("digest"))


_ASSERTED = r"""
WITH t AS (SELECT doc_id, '> quoted line' || chr(10) || text || chr(10) || '~struck out~ kept `code` end' || chr(10) || '```' || chr(10) || 'fenced' || chr(10) || '```' AS t FROM documents),
  a AS (SELECT doc_id, regexp_replace(t, '(?s)```.*?(?:```|\z)', ' ', 'g') AS t FROM t),
  b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^[ \t]*(?:&gt;|>)[ \t]?.*$', ' ', 'g'), '~([^~\n]{2,})~', ' ', 'g'), '`[^`\n]+`', ' ', 'g') AS t FROM a),
  l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM b)
SELECT doc_id, len(lines) AS n, sha1(array_to_string(lines, ' ')) AS digest FROM l
"""


def flatten_turns(spark: SparkSession, d: str) -> DataFrame:
    """Threads nested as an export has them, and flattened again."""
    nested = R.nested(conversation_records(spark, d))
    return R.flattened(nested).select("id", "thread_ts", F.col("position").cast("bigint").alias("position"))


def thread_rollup(spark: SparkSession, d: str) -> DataFrame:
    rolled = R.rollups(conversation_records(spark, d).withColumnRenamed("turn", "pos"))
    return rolled.select("id", F.col("messages").cast("bigint").alias("messages"), F.sha1(F.col("text").cast("binary")).alias("digest"))


def upsert_by_id(spark: SparkSession, d: str) -> DataFrame:
    r = conversation_records(spark, d).select("id", "text", "turn")
    fresh = r.where("turn % 3 = 0").withColumn("text", F.lit("edited")).unionByName(r.where("turn = 0").withColumn("id", F.concat(F.lit("new_"), "id")))
    return upserts.upsert(r, fresh).select("id", "text")


def carry_forward_heading(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document under the last line of one or two words above it."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.when(F.size(F.split(F.trim("line"), " ")) <= 2, F.trim("line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    under = lines.withColumn("heading", F.last(head, ignorenulls=True).over(w)).where("heading is not null")
    return under.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first"))


def run_merge(spark: SparkSession, d: str) -> DataFrame:
    """Turns of one person in a row, as long as they are within 90 seconds of the run's beginning."""
    r = conversation_records(spark, d).select("thread_ts", "turn", "ts", F.when(F.col("turn") % 4 < 3, "a").otherwise("b").alias("user"), "text")
    merged = R.merged_runs(r, "thread_ts", 90.0)
    return merged.select("thread_ts", "user", F.col("ts").cast("bigint").alias("ts"), F.col("n").cast("bigint").alias("n"))


# relations


#: Turns that say something about the ones before, by (conversation + turn) modulo 5; the rest keep their text.
_SAID = ["can you check the build?", "yes that is how", "blocked, waiting on review", "any update on this?"]


def _typed(spark: SparkSession, d: str) -> DataFrame:
    r = conversation_records(spark, d).withColumn("pos", F.col("turn"))
    r = r.withColumn("text", F.coalesce(F.get(F.array(*map(F.lit, _SAID)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)).cast("int")), F.col("text")))
    pairs = relations.by_time(signals.thread_pairs(r), r.select("id", "ts", "pos"))
    return relations.typed(pairs, relations.read(r))


def cue_relations(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where(F.col("relation") != cues.UNTYPED).select("source", "target", "relation", "score", "evidence")


def relation_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def timeline_dedup(spark: SparkSession, d: str) -> DataFrame:
    r = conversation_records(spark, d)
    found = state.timeline(_moves(r), r)
    return found.select("relation", "to_id", F.col("ts").cast("bigint").alias("ts"), "from_id", F.col("from_ts").cast("bigint").alias("from_ts"), "also_answers")


def _moves(r: DataFrame) -> DataFrame:
    """Every later turn of a conversation follows up every earlier one; every third resolves it."""
    pairs = r.alias("a").join(r.alias("b"), "thread_ts").where("a.turn < b.turn")
    return pairs.select(F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.when(F.col("b.turn") % 3 == 0, "resolves").otherwise("follows_up").alias("relation"))


def waiting_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that wait for something, put there by their id."""
    docs = table(spark, d, "documents")
    says = F.when(F.pmod("doc_id", F.lit(5)) == 0, "\n- pending review from <@U1234567>").when(F.pmod("doc_id", F.lit(5)) == 1, "\n- Done all pending work items").when(F.pmod("doc_id", F.lit(5)) == 2, "\n*Pending task*\nanswer of the other team").when(F.pmod("doc_id", F.lit(5)) == 3, "\n- still waiting on the build?").otherwise("\nall closed but blocked on data now")
    r = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("user"), F.col("doc_id").cast("double").alias("ts"), says.alias("text"))
    return state.waiting_lines(r).select("id", "line", "cue", F.array_join("waiting_on", ",").alias("waiting_on"), "from_heading")


_WAITING = """
SELECT 'd' || doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'pending review from <@U1234567>' WHEN 2 THEN 'answer of the other team' ELSE 'all closed but blocked on data now' END AS line,
       CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 2 THEN 'heading' ELSE 'blocked' END AS cue, CASE doc_id % 5 WHEN 0 THEN 'U1234567' ELSE '' END AS waiting_on, doc_id % 5 = 2 AS from_heading
FROM documents WHERE doc_id % 5 IN (0, 2, 4)
"""


# anchors, edges, communities


def anchor_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    a = signals.anchor_table(docs, kinds=["acronym", "version"])
    return signals.anchor_idf(a, docs.count()).select("anchor", "df", F.round("idf", 6).alias("idf"))


_ANCHOR_IDF = r"""
WITH f AS (SELECT DISTINCT doc_id, lower(unnest(list_concat(regexp_extract_all(t, '\b[A-Z]{3,6}\b'), regexp_extract_all(t, '\bv?\d+\.\d+(?:\.\d+)?\b')))) AS anchor FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '_', 'g') AS t FROM documents)),
  k AS (SELECT * FROM f WHERE length(anchor) >= 3 AND anchor NOT IN (%s)), n AS (SELECT count(*) AS n FROM documents)
SELECT anchor, count(*) AS df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM k CROSS JOIN n GROUP BY anchor
""" % ", ".join(f"'{w}'" for w in signals.COMMON)


def anchor_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of what a page's url pins down other pages share: hosts and digits of its path."""
    a = _url_anchors(spark, d)
    asked = a.where(F.pmod("id", F.lit(20)) == 0).select(F.col("id").alias("query_id"), "anchor")
    idfs = signals.anchor_idf(a, table(spark, d, "pages").count())
    return signals.anchor_overlap(a, idfs, asked).where("query_id != id").select("query_id", "id", F.round("score", 6).alias("score"))


def _url_anchors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").where("url is not null")
    parts = F.array_distinct(F.array(F.regexp_extract("url", r"://([^/]+)", 1), F.regexp_extract("url", r"/([a-z]{2})/", 1)))
    return p.select(F.col("page_id").alias("id"), F.explode(parts).alias("anchor")).where("anchor != ''").distinct()


_URL_ANCHORS = r"a AS (SELECT DISTINCT page_id AS id, unnest([regexp_extract(url, '://([^/]+)', 1), regexp_extract(url, '/([a-z]{2})/', 1)]) AS anchor FROM pages WHERE url IS NOT NULL), k AS (SELECT * FROM a WHERE anchor <> ''), n AS (SELECT count(*) AS n FROM pages), w AS (SELECT anchor, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM k CROSS JOIN n GROUP BY anchor)"


def pair_signals(spark: SparkSession, d: str) -> DataFrame:
    r = conversation_records(spark, d)
    words = r.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) >= 6))).alias("anchor"))
    idfs = signals.anchor_idf(words, r.count())
    found = signals.pair_signals(signals.thread_pairs(r), r, words, idfs)
    return found.select("l", "r", "thread", F.round("time", 6).alias("time"), "user", "channel", F.round("anchors", 6).alias("anchors"))


_PAIRS = rf"""
WITH {RECORDS}, w AS (SELECT DISTINCT id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS anchor FROM rec), k AS (SELECT * FROM w WHERE length(anchor) >= 6),
  n AS (SELECT count(*) AS n FROM rec), i AS (SELECT anchor, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM k CROSS JOIN n GROUP BY anchor),
  s AS (SELECT id, sum(idf) AS w FROM k JOIN i USING (anchor) GROUP BY id),
  p AS (SELECT a.id AS l, b.id AS r, a.ts AS lt, b.ts AS rt, a."user" = b."user" AS u, a.channel_id = b.channel_id AS c FROM rec a JOIN rec b ON a.thread_ts = b.thread_ts AND a.id < b.id),
  sh AS (SELECT p.l, p.r, sum(idf) AS s FROM p JOIN k a ON a.id = p.l JOIN k b ON b.id = p.r AND b.anchor = a.anchor JOIN i ON i.anchor = a.anchor GROUP BY ALL)
SELECT p.l, p.r, 1.0::DOUBLE AS thread, round(CASE WHEN abs(lt - rt) / 60 <= 2880 THEN exp(-abs(lt - rt) / 60 / 90) ELSE 0 END, 6) AS "time", u::INT::DOUBLE AS "user", c::INT::DOUBLE AS channel,
       round(CASE WHEN coalesce(a.w, 0) + coalesce(b.w, 0) > 0 THEN 2 * coalesce(sh.s, 0) / (coalesce(a.w, 0) + coalesce(b.w, 0)) ELSE 0 END, 6) AS anchors
FROM p LEFT JOIN s a ON a.id = p.l LEFT JOIN s b ON b.id = p.r LEFT JOIN sh ON sh.l = p.l AND sh.r = p.r
"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, mutual-neighbour edges and neighbours of the vectors."""
    from ..operators import vectors

    v = table(spark, d, "embeddings")
    near = written(vectors.knn(v, 6))  # several steps read it, and each would compare all vectors again
    edge = written(vectors.mutual(near).select("l", "r", F.greatest("sim", F.lit(0.0)).alias("weight")).where(F.col("weight") >= signals.LEAST))
    return v.select(F.col("vec_id").alias("id"), F.col("label").alias("truth")), edge, near


def similarity_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the conversation graph: all signals weighted, the weak ones dropped."""
    r = conversation_records(spark, d)
    words = r.select("id", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda x: F.length(x) >= 6))).alias("anchor"))
    found = signals.pair_signals(signals.thread_pairs(r), r, words, signals.anchor_idf(words, r.count())).withColumn("dense", F.lit(0.0))
    return signals.edges(found).select("l", "r", F.round("weight", 6).alias("weight"))


def isolate_rescue(spark: SparkSession, d: str) -> DataFrame:
    nodes, edge, near = _graph(spark, d)
    return signals.rescued(nodes, edge, near).select("l", "r", F.round("weight", 6).alias("weight"))


def _communities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edge, near = _graph(spark, d)
    whole = written(edge.unionByName(signals.rescued(nodes, edge, near)))
    return louvain.communities(nodes.select("id"), whole), whole


def communities(spark: SparkSession, d: str) -> DataFrame:
    found, _ = _communities(spark, d)
    return signals.size_ranked(found).select("id", F.col("label").cast("bigint").alias("label"), F.col("size").cast("bigint").alias("size"))


def community_quality(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the communities found, and how they agree with the true labels."""
    found, whole = _communities(spark, d)
    labels = written(found.select("id", F.col("community").alias("label")))
    truth = labels.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth")), "id")
    return signals.modularity(whole, labels).crossJoin(signals.agreement(truth)).select(F.round("modularity", 6).alias("modularity"), F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


def community_laws(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the communities found, whatever they are: a row for each law."""
    found, whole = _communities(spark, d)
    found = written(found)
    nodes = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))
    labels = found.select("id", F.col("community").alias("label"))
    inside = components(whole).join(labels, "id")
    law = lambda name, df: df.select(F.lit(name).alias("law"), F.col("n").cast("bigint").alias("n"))
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    better = signals.modularity(whole, labels).select(F.col("modularity").alias("m")).crossJoin(signals.modularity(whole, nodes.select("id", F.col("truth").alias("label"))))
    rows = [
        law("nodes", count(nodes.join(labels, "id", "left_semi"))),
        law("nodes in two communities", count(labels.groupBy("id").count().where("count > 1"))),
        law("named by another than the least member", count(labels.groupBy("label").agg(F.min("id").alias("least")).where("least != label"))),
        law("communities of nodes that no path joins", count(inside.groupBy("label").agg(F.count_distinct("component").alias("k")).where("k > 1"))),
        law("modularity not above that of the true labels", count(better.where("m <= modularity"))),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def modularity(spark: SparkSession, d: str) -> DataFrame:
    nodes, edge, _ = _graph(spark, d)
    return signals.modularity(edge, nodes.select("id", F.col("truth").alias("label"))).select(F.round("modularity", 6).alias("modularity"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.floor((F.element_at("embedding", 1).cast("double") + 1) * 4).cast("bigint").alias("label"))


def ari_nmi(spark: SparkSession, d: str) -> DataFrame:
    return signals.agreement(_labelled(spark, d)).select(F.round("ari", 6).alias("ari"), F.round("nmi", 6).alias("nmi"))


def cluster_purity(spark: SparkSession, d: str) -> DataFrame:
    return signals.purity(_labelled(spark, d)).select("label", "size", F.round("purity", 6).alias("purity"))


# links


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Line items as messages: some name their order's ticket, their order is the thread, their supplier the channel."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    key = F.concat(F.lit("ORD-"), F.pmod("l_orderkey", F.lit(500)).cast("string"))
    other = F.concat(F.lit("ORD-"), F.pmod("l_partkey", F.lit(500)).cast("string"))
    text = F.when(F.col("l_linenumber") == 2, F.concat(F.lit("see "), key)).when(F.col("l_linenumber") == 4, F.concat(other, F.lit(" waits for "), key)).otherwise("no key in UTF-8 here")
    return li.select(F.format_string("m%d_%d", "l_orderkey", "l_linenumber").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_orderkey").cast("string").alias("thread_ts"), F.concat(F.lit("S"), F.pmod("l_suppkey", F.lit(5)).cast("string")).alias("channel_id"), text.alias("text"), F.pmod("l_suppkey", F.lit(40)).alias("label"))


_LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL)"
_MESSAGES = _LINES + ", msg AS (SELECT 'm' || l_orderkey || '_' || l_linenumber AS id, l_orderkey * 10 + l_linenumber AS pos, l_orderkey::VARCHAR AS thread, l_suppkey % 40 AS label, CASE l_linenumber WHEN 2 THEN ['ORD-' || (l_orderkey % 500)] WHEN 4 THEN ['ORD-' || (l_partkey % 500), 'ORD-' || (l_orderkey % 500)] ELSE [] END AS keys FROM li)"
_EXPLICIT = f"""{_MESSAGES},
  named AS (SELECT id, unnest(keys) AS k, generate_subscripts(keys, 1) AS p FROM msg), cnt AS (SELECT k, count(DISTINCT id) AS n FROM named GROUP BY k),
  ex AS (SELECT id, 'ticket:' || k AS key FROM (SELECT id, k, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS r FROM named JOIN cnt USING (k)) WHERE r = 1),
  tv AS (SELECT thread, key FROM (SELECT thread, key, row_number() OVER (PARTITION BY thread ORDER BY count(*) DESC, min(pos)) AS r FROM msg JOIN ex USING (id) GROUP BY thread, key) WHERE r = 1),
  st AS (SELECT msg.id, pos, label, coalesce(ex.key, tv.key) AS key, CASE WHEN ex.key IS NOT NULL THEN 'explicit' WHEN tv.key IS NOT NULL THEN 'thread' END AS tier FROM msg LEFT JOIN ex USING (id) LEFT JOIN tv USING (thread))"""


def link_thread_vote(spark: SparkSession, d: str) -> DataFrame:
    return relations.link(_messages(spark, d)).groupBy("key", "tier", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Messages whose cluster can agree: two tickets in all, one much more common."""
    m = _messages(spark, d)
    return m.withColumn("text", F.when(F.col("pos") % 7 == 0, F.when(F.col("pos") % 5 == 0, "see REV-22").otherwise("see REV-21")).otherwise("nothing named")).withColumn("thread_ts", F.lit(""))


def link_consensus(spark: SparkSession, d: str) -> DataFrame:
    m = _small(spark, d)
    found = relations.link(m, clusters=m.select("id", "label"))
    return found.groupBy("key", "tier", "confidence").agg(F.count(F.lit(1)).alias("n"))


_CONSENSUS = f"""
WITH {_LINES}, m AS (SELECT 'm' || l_orderkey || '_' || l_linenumber AS id, l_orderkey * 10 + l_linenumber AS pos, l_suppkey % 40 AS label FROM li),
  e AS (SELECT *, CASE WHEN pos % 7 = 0 THEN CASE WHEN pos % 5 = 0 THEN 'ticket:REV-22' ELSE 'ticket:REV-21' END END AS key FROM m),
  v AS (SELECT label, key, count(*) AS votes, sum(count(*)) OVER (PARTITION BY label) AS linked, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(pos)) AS r FROM e WHERE key IS NOT NULL GROUP BY label, key),
  a AS (SELECT label, key AS ck FROM v WHERE r = 1 AND linked >= 2 AND votes / linked >= 0.5), s AS (SELECT label, count(*) AS size FROM m GROUP BY label),
  f AS (SELECT CASE WHEN key IS NOT NULL THEN key WHEN size < 2 THEN '' WHEN ck IS NOT NULL THEN ck ELSE 'cluster:' || e.label END AS key, CASE WHEN key IS NOT NULL THEN 'explicit' WHEN size < 2 THEN 'unassigned' WHEN ck IS NOT NULL THEN 'consensus' ELSE 'cluster' END AS tier FROM e JOIN s USING (label) LEFT JOIN a USING (label))
SELECT key, tier, CASE tier WHEN 'explicit' THEN 1.0 WHEN 'consensus' THEN 0.75 WHEN 'cluster' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS n FROM f GROUP BY ALL
"""


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    """A log of overrides from orders: the last one of a message wins; some messages don't exist, some are unlinked."""
    o = table(spark, d, "orders")
    log = o.select(F.format_string("m%d_1", "o_orderkey").alias("id"), F.lit("ticket:OLD-1").alias("key"), F.lit(1).alias("pos")).unionByName(o.select(F.format_string("m%d_1", "o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 100 == 0, "").otherwise("ticket:NEW-2").alias("key"), F.lit(2).alias("pos")))
    gone = o.select(F.format_string("gone%d", "o_orderkey").alias("id"), F.lit("ticket:X-1").alias("key"), F.lit(1).alias("pos"))
    return relations.last_overrides(log.unionByName(gone))


def link_overrides(spark: SparkSession, d: str) -> DataFrame:
    return relations.link(_messages(spark, d), overrides=_overrides(spark, d)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("key") == "", 1)).alias("unlinked"))


def unresolved_links(spark: SparkSession, d: str) -> DataFrame:
    return relations.unresolved(_overrides(spark, d), _messages(spark, d))


def item_owner(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    topics = m.select("id", F.col("pos").cast("double").alias("ts"), F.col("label").alias("topic"))
    return relations.item_ids(topics, relations.explicit(m, relations.trusted_prefixes(m))).select("topic", "item_id", "ticket_votes")


_OWNER = f"""
WITH {_EXPLICIT}, v AS (SELECT label AS topic, key, count(*) AS n, min(pos) AS f FROM msg JOIN ex USING (id) GROUP BY ALL),
  b AS (SELECT topic, key, n FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, f, key DESC) AS r FROM v) WHERE r = 1),
  g AS (SELECT label AS topic, min((pos, id)) AS begun, arg_min(id, (pos, id)) AS first_id FROM msg GROUP BY ALL),
  o AS (SELECT topic, key, n FROM (SELECT b.*, row_number() OVER (PARTITION BY key ORDER BY n DESC, begun, topic) AS r FROM b JOIN g USING (topic)) WHERE r = 1)
SELECT g.topic, coalesce(substr(o.key, 8), 'c' || substr(sha1(first_id), 1, 6)) AS item_id, coalesce(o.n, 0) AS ticket_votes FROM g LEFT JOIN o USING (topic)
"""


def content_ids(spark: SparkSession, d: str) -> DataFrame:
    return relations.content_ids(conversation_records(spark, d).withColumn("topic", F.col("conv_id")))


# state


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.col("event_type")
    relation = F.when(kind == "error", "blocked_by").when(kind == "purchase", "resolves").when(kind == "click", "follows_up").when(kind == "view", "answers").otherwise("duplicates")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("topic"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("user_id").alias("user"), (F.col("event_id") % 17 == 0).alias("is_bot"), F.col("props").alias("said"), relation.alias("relation"), F.lit("event").alias("evidence"))


def _steps(e: DataFrame) -> DataFrame:
    """Each event against the one before it of the same person."""
    before = F.lag("id").over(Window.partitionBy("topic").orderBy("ts", "id"))
    return e.withColumn("source", before).where("source is not null").select("source", F.col("id").alias("target"), "relation", "evidence")


_EVENTS = "ev AS (SELECT event_id AS id, user_id AS topic, epoch_us(ts) / 1e6 AS ts, event_id % 17 = 0 AS is_bot, props AS said, CASE event_type WHEN 'error' THEN 'blocked_by' WHEN 'purchase' THEN 'resolves' WHEN 'click' THEN 'follows_up' WHEN 'view' THEN 'answers' ELSE 'duplicates' END AS relation FROM events), st AS (SELECT *, lag(id) OVER (PARTITION BY topic ORDER BY ts, id) AS source, count(*) OVER (PARTITION BY topic) AS size FROM ev)"
_STATE = f"""{_EVENTS}, g AS (SELECT *, relation IN ('resolves', 'blocked_by') AND NOT is_bot AND NOT (length(said) <= 25 AND size > 10) AS decides FROM st WHERE source IS NOT NULL),
  s AS (SELECT topic, max(CASE WHEN decides THEN (ts, id) END) AS d, arg_max(relation, (ts, id)) FILTER (decides) AS rel, arg_max(id, (ts, id)) FILTER (decides) AS did, max(ts) FILTER (decides) AS dts, arg_max(id, (ts, id)) AS mid, max(ts) AS mts FROM g GROUP BY topic),
  f AS (SELECT topic, CASE WHEN did IS NULL THEN 'active' WHEN rel = 'resolves' THEN 'resolved' ELSE 'blocked' END AS state, coalesce(did, mid) AS evidence_id, coalesce(dts, mts) AS since, CASE WHEN did IS NULL OR mts > dts THEN mid END AS moved_id FROM (SELECT DISTINCT topic FROM ev) LEFT JOIN s USING (topic))"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return state.inferred(_steps(e), e)


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("topic", "state", "evidence_id", F.round("since", 3).alias("since"), "moved_id")


def state_gate(spark: SparkSession, d: str) -> DataFrame:
    """How many deciding events of each kind the gate lets through."""
    e = _events(spark, d).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("topic")))
    ok = state.may_decide(F.col("is_bot"), F.col("said"), F.col("size"))
    return e.where(F.col("relation").isin(state.DECIDING)).groupBy("relation").agg(F.count(F.lit(1)).alias("events"), F.count(F.when(ok, 1)).alias("allowed"))


def _declared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = _events(spark, d)
    declared_ = e.where("relation = 'blocked_by' and id % 5 = 0").select("id", F.array(F.concat(F.lit("waiting for "), F.col("id").cast("string"))).alias("answers"))
    cleared = e.where("relation = 'resolves' and id % 3 = 0").groupBy("user").agg(F.max("ts").alias("cleared"))
    return e, declared_, cleared


def declarations_asof(spark: SparkSession, d: str) -> DataFrame:
    e, declared_, cleared = _declared(spark, d)
    found = state.with_declarations(state.inferred(_steps(e), e), e.select("id", "topic", "user", "ts"), declared_, cleared)
    return found.select("topic", "state", "evidence_id", "declared")


_DECLARED = f"""
WITH {_STATE}, c AS (SELECT topic, max(ts) AS cleared FROM ev WHERE relation = 'resolves' AND id % 3 = 0 GROUP BY topic),
  l AS (SELECT ev.topic, arg_max(id, (ts, id)) AS did FROM ev LEFT JOIN c USING (topic) WHERE relation = 'blocked_by' AND id % 5 = 0 AND (cleared IS NULL OR cleared <= ts) GROUP BY ev.topic)
SELECT topic, CASE WHEN l.did IS NOT NULL THEN 'blocked' ELSE state END AS state, coalesce(l.did, evidence_id) AS evidence_id, 'waiting for ' || l.did AS declared FROM f LEFT JOIN l USING (topic)
"""


def window_topics(spark: SparkSession, d: str) -> DataFrame:
    """People's items touched in the last two days of the events."""
    e = _events(spark, d).withColumn("source", F.when(F.col("id") % 3 == 0, "youtrack").otherwise("slack")).withColumn("topic", F.col("topic") * 10 + F.pmod("id", F.lit(7)))
    until = F.unix_micros(F.lit(NOW).cast("timestamp")) / 1e6
    end = spark.range(1).select(until.alias("u")).first()["u"]
    found = state.in_window(e.withColumn("user", F.col("user").cast("string")), end - 2 * 86400, end)
    return found.select("topic", "messages", F.round("first_ts", 3).alias("first_ts"), F.round("last_ts", 3).alias("last_ts"), F.array_join("people", ",").alias("people"))


def digest_order(spark: SparkSession, d: str) -> DataFrame:
    """Items in the order of a digest."""
    found = _states(spark, d)
    last = _events(spark, d).groupBy("topic").agg(F.max("ts").alias("last"))
    both = found.join(last, "topic")
    order = Window.orderBy(*state.digest_order(F.col("state"), F.col("last")), "topic")
    return both.withColumn("place", F.row_number().over(order).cast("bigint")).select("place", "topic", "state", F.round("last", 3).alias("last"))


def state_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


# drift


def _tickets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Topics with a ticket and state, tickets, and messages: every fourth order's first line names it."""
    o = table(spark, d, "orders").select(F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("ticket"), (F.col("o_orderstatus") == "F").alias("resolved"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("updated"), "o_orderkey")
    rows = table(spark, d, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    li = rows.select(F.col("l_orderkey").alias("topic"), F.col("l_linenumber").cast("bigint").alias("line"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e6).alias("ts"), "l_returnflag", "row")
    # of lines with the same time and number the table's first says what the state is
    last = F.min_by("l_returnflag", F.struct(-F.col("ts"), -F.col("line"), "row"))
    topics = li.groupBy("topic").agg(last.alias("x")).select("topic", F.concat(F.lit("ord-"), F.col("topic").cast("string")).alias("ticket"), F.when(F.col("x") == "R", "blocked").when(F.col("x") == "A", "resolved").otherwise("active").alias("state"))
    said = li.select("topic", F.concat(F.lit("ord-"), F.col("topic").cast("string")).alias("ticket"), "ts", (F.col("topic") * 10 + F.col("line")).alias("id"), F.when((F.col("line") == 1) & (F.col("topic") % 4 != 0), F.concat(F.lit("about ORD-"), F.col("topic").cast("string"))).otherwise("no key").alias("text"), F.lit(False).alias("tracker"))
    return topics, o, said


_TICKETS = """tk AS (SELECT 'ORD-' || o_orderkey AS ticket, o_orderstatus = 'F' AS resolved, epoch_us(o_orderdate) / 1e6 AS updated, o_orderkey AS topic FROM orders),
  tp AS (SELECT l_orderkey AS topic, 'ord-' || l_orderkey AS ticket, CASE arg_max(l_returnflag, (l_shipdate, l_linenumber)) WHEN 'R' THEN 'blocked' WHEN 'A' THEN 'resolved' ELSE 'active' END AS state FROM lineitem GROUP BY l_orderkey),
  mn AS (SELECT l_orderkey AS topic, count(*) AS mentions, max(epoch_us(l_shipdate) / 1e6) AS last_ts, max(l_orderkey * 10 + l_linenumber) AS last_id FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 4 <> 0 GROUP BY ALL),
  dr AS (SELECT tp.topic, tp.ticket, state, resolved, mentions, last_ts, last_id, CASE WHEN resolved AND state = 'blocked' THEN 'ticket_closed_but_slack_blocked' WHEN resolved AND updated > 0 AND last_ts > updated + 21600 THEN 'ticket_closed_but_talking'
          WHEN NOT resolved AND state = 'blocked' THEN 'slack_blocked_but_ticket_open' WHEN NOT resolved AND state = 'resolved' THEN 'slack_resolved_but_ticket_open' END AS kind FROM tp JOIN tk USING (topic) JOIN mn USING (topic))"""


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    topics, tickets, said = _tickets(spark, d)
    return drift.detect(topics, tickets, drift.mentions(said)), topics, tickets


def drift_four_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d)[0].where("kind is not null").select("topic", "ticket", "state", "resolved", "kind", "mentions", "last_id")


def silent_tickets(spark: SparkSession, d: str) -> DataFrame:
    _, tickets, said = _tickets(spark, d)
    named = drift.mentions(said).select(F.upper("ticket").alias("ticket"))
    now = spark.sql(f"select unix_seconds(timestamp'{NOW}') as s").first()["s"]
    return drift.silent(tickets, named, float(now)).select("ticket", F.round("idle_days", 3).alias("idle_days"))


def quiet_tickets(spark: SparkSession, d: str) -> DataFrame:
    """All open tickets without a change for long, against every text: also those that no topic has."""
    _, tickets, said = _tickets(spark, d)
    now = spark.sql(f"select unix_seconds(timestamp'{NOW}') as s").first()["s"]
    return drift.quiet(tickets, said.select("text"), float(now)).select("ticket", F.round("idle_days", 3).alias("idle_days"), "mentioned")


def coverage(spark: SparkSession, d: str) -> DataFrame:
    topics, tickets, _ = _tickets(spark, d)
    return drift.coverage(topics, tickets)


def agreement(spark: SparkSession, d: str) -> DataFrame:
    judged, topics, _ = _drift(spark, d)
    return drift.agreement(judged, topics).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select("user", F.pmod("id", F.lit(60)).alias("topic"), "ts", "relation")
    last = e.groupBy("topic").agg(F.max_by("relation", "ts").alias("r"))
    return e.join(last, "topic").select("user", "topic", "ts", F.when(F.col("r") == "blocked_by", "blocked").otherwise("active").alias("state"))


_MEMBERS = f"{_EVENTS}, tt AS (SELECT topic AS \"user\", id % 60 AS topic, ts, relation FROM ev), tl AS (SELECT topic, CASE WHEN arg_max(relation, ts) = 'blocked_by' THEN 'blocked' ELSE 'active' END AS state FROM tt GROUP BY topic), mb AS (SELECT \"user\", topic, ts, state FROM tt JOIN tl USING (topic))"


def people_rows(spark: SparkSession, d: str) -> DataFrame:
    return drift.people(_members(spark, d)).select("user", "items", "blocked", "messages", F.round("last_ts", 3).alias("last_ts"))


def person_partners(spark: SparkSession, d: str) -> DataFrame:
    return drift.best_partners(_members(spark, d), 5).select("user", "partner", "items")


# dailies


def _dailies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("date", F.to_date("ts"))
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "Pending: ").otherwise(""), F.lit("build #"), (F.col("user_id") % 3).cast("string"), F.when(F.col("event_id") % 2 == 0, "!").otherwise(""))
    blockers = e.where("event_type in ('error', 'view')").select("date", F.col("user_id").alias("user"), T.normal_blocker(text).alias("blocker"))
    return blockers, e.where(F.dayofweek("date").between(2, 6)).select("date").distinct()


_DAILIES = "b AS (SELECT DISTINCT ts::DATE AS date, user_id AS \"user\", 'build ' || (user_id % 3) AS blocker FROM events WHERE event_type IN ('error', 'view')), dy AS (SELECT date, row_number() OVER (ORDER BY date) AS day FROM (SELECT DISTINCT ts::DATE AS date FROM events WHERE isodow(ts) <= 5)), rn AS (SELECT \"user\", blocker, date, day, day - row_number() OVER (PARTITION BY \"user\", blocker ORDER BY day) AS run FROM b JOIN dy USING (date)), sk AS (SELECT \"user\", blocker, count(*) AS days, min(date) AS since FROM rn GROUP BY \"user\", blocker, run HAVING max(day) = (SELECT max(day) FROM dy))"


def pending_streaks(spark: SparkSession, d: str) -> DataFrame:
    return drift.streaks(*_dailies(spark, d)).select("user", "blocker", "days", F.col("since").cast("string").alias("since"))


def escalate_once(spark: SparkSession, d: str) -> DataFrame:
    found = drift.streaks(*_dailies(spark, d))
    told = found.where("user % 2 = 0").select("user", "blocker")
    return drift.escalations(found, told, 3).select("user", "blocker", "days")


def business_days_stale(spark: SparkSession, d: str) -> DataFrame:
    """People without an event for three working days, in steps of three."""
    last = table(spark, d, "events").where("event_type = 'error'").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("last"))
    days = when.business_days(F.col("last"), F.lit(NOW).cast("date"))
    return last.withColumn("workdays", days).where("workdays >= 3").select("user_id", "workdays", when.bucket(F.col("workdays"), 3).alias("bucket"))


def decision_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each person's purchases supersede the one before."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    found = decisions.chains(e.select(F.col("event_id").alias("id"), nxt.alias("superseded_by")))
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("length"), F.max_by("id", "step").alias("last"))


_CHAIN = """
WITH RECURSIVE p AS (SELECT event_id AS id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events WHERE event_type = 'purchase'),
  c(start, id, step) AS (SELECT id, id, 0 FROM p UNION ALL SELECT c.start, p.nxt, c.step + 1 FROM c JOIN p ON p.id = c.id WHERE p.nxt IS NOT NULL)
SELECT start, count(*) AS length, arg_max(id, step) AS last FROM c GROUP BY start
"""


# scalars


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events by key: how many events have it, and its values."""
    e = table(spark, d, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    return e.select(F.explode("m").alias("key", "value")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"))


def hash_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.concat(F.lit("note_"), F.left(F.sha1(F.col("text").cast("binary")), F.lit(10))).alias("note"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")).distinct()


#: Names for the pseudonym query; a deployment brings its own lists.
FIRSTS, LASTS = ["Amber", "Birch", "Cedar", "Dune", "Ember", "Fern", "Grove"], ["Falcon", "Heron", "Lynx", "Otter", "Wren"]


def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user")).distinct()
    return u.select("user", T.pseudonym(F.col("user"), FIRSTS, LASTS).alias("name"))


_PSEUDONYMS = f"SELECT DISTINCT 'U' || user_id AS \"user\", list_extract({FIRSTS!r}, ('0x' || substr(sha1('U' || user_id), 1, 2))::INT % 7 + 1) || ' ' || list_extract({LASTS!r}, ('0x' || substr(sha1('U' || user_id), 3, 2))::INT % 5 + 1) AS name FROM events"


QUERIES = {
    f.__name__: f
    for f in (
        normalize_markup, usefulness_filter, asserted_lines, flatten_turns, thread_rollup, upsert_by_id, carry_forward_heading, run_merge,
        cue_relations, relation_histogram, timeline_dedup, waiting_lines, anchor_idf, anchor_overlap, pair_signals, similarity_edges, isolate_rescue,
        communities, community_quality, community_laws, modularity, ari_nmi, cluster_purity, link_thread_vote, link_consensus, link_overrides, unresolved_links,
        item_owner, content_ids, latest_state, state_gate, declarations_asof, window_topics, digest_order, state_histogram,
        drift_four_kinds, silent_tickets, quiet_tickets, coverage, agreement, people_rows, person_partners, pending_streaks, escalate_once, business_days_stale,
        decision_chain, json_props, hash_ids, pseudonyms,
    )
}

_ANSWER_CUES = [c for c in cues.RELATIONS["answers"][2] if c.isascii()]
_ANSWER = "CASE " + " ".join("WHEN regexp_matches(lower(regexp_replace(b.text, '\\s+', ' ', 'g')), '(?s)^(?:.{0,47}[^a-z])?%s(?:[^a-z]|$)') THEN 'cue %s'" % ((c.replace("'", "''"),) * 2) for c in _ANSWER_CUES) + " END"
_TYPED = f"""{RECORDS}, pr AS (SELECT a.id AS source, b.id AS target, (b.conv_id + b.turn) % 5 AS said, (a.conv_id + a.turn) % 5 IN (0, 3) OR ((a.conv_id + a.turn) % 5 = 4 AND contains(a.text, '?')) AS asked, {_ANSWER} AS own FROM rec a JOIN rec b ON a.thread_ts = b.thread_ts AND a.turn < b.turn),
  ty AS (SELECT source, target, CASE WHEN asked AND (said = 1 OR (said = 4 AND own IS NOT NULL)) THEN 'answers' WHEN said = 2 THEN 'blocked_by' WHEN said = 3 THEN 'follows_up' ELSE 'same_topic' END AS relation, own, said FROM pr)"""
_LABELLED = "e AS (SELECT vec_id, label AS truth, floor((embedding[1]::DOUBLE + 1) * 4)::BIGINT AS label FROM embeddings)"
_MUTUAL = """p AS (SELECT a.vec_id AS l, b.vec_id AS r, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS sim FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id <> b.vec_id),
  n AS (SELECT l, r, sim, row_number() OVER (PARTITION BY l ORDER BY round(sim, 9) DESC, r) AS rank FROM p QUALIFY rank <= 6),
  g AS (SELECT a.l, a.r, greatest(a.sim, 0) AS weight FROM n a JOIN n b ON a.l = b.r AND a.r = b.l WHERE a.l < a.r AND a.sim >= 0.05)"""

ORACLE = {
    "normalize_markup": "SELECT page_id, 'see page ' || page_id || ' and ' || regexp_replace(url, '^https?://', '') || ' from @U' || page_id || chr(10) || 'ok' AS plain, 'U' || page_id AS people FROM pages WHERE url IS NOT NULL",
    "usefulness_filter": "SELECT conv_id, turn FROM conversations WHERE conv_id % 7 NOT IN (0, 1)",
    "asserted_lines": _ASSERTED,
    "flatten_turns": f"WITH {RECORDS} SELECT id, thread_ts, row_number() OVER (PARTITION BY thread_ts ORDER BY turn) - 1 AS position FROM rec",
    "thread_rollup": f"WITH {RECORDS} SELECT 'thread_' || any_value(channel_id) || '_' || thread_ts AS id, count(*) AS messages, sha1(array_to_string(list(text ORDER BY turn)[1:21], chr(10))) AS digest FROM rec GROUP BY thread_ts HAVING count(*) > 1",
    "upsert_by_id": f"WITH {RECORDS} SELECT id, CASE WHEN turn % 3 = 0 THEN 'edited' ELSE text END AS text FROM rec UNION ALL SELECT 'new_' || id, text FROM rec WHERE turn = 0",
    "carry_forward_heading": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), h AS (SELECT doc_id, pos, last_value(CASE WHEN len(string_split(trim(line), ' ')) <= 2 THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS heading FROM l) SELECT doc_id, heading, count(*) AS n, min(pos) AS first FROM h WHERE heading IS NOT NULL GROUP BY ALL",
    "cue_relations": f"WITH {_TYPED} SELECT source, target, relation, CASE relation WHEN 'blocked_by' THEN 0.9 ELSE 0.7 END::DOUBLE AS score, CASE relation WHEN 'blocked_by' THEN 'cue blocked' WHEN 'answers' THEN CASE said WHEN 1 THEN 'cue yes' ELSE own END ELSE 'cue any update' END AS evidence FROM ty WHERE relation <> 'same_topic'",
    "relation_histogram": f"WITH {_TYPED} SELECT relation, count(*) AS n FROM ty GROUP BY relation",
    "timeline_dedup": f"WITH {RECORDS} SELECT CASE WHEN b.turn % 3 = 0 THEN 'resolves' ELSE 'follows_up' END AS relation, b.id AS to_id, any_value(b.ts)::BIGINT AS ts, arg_min(a.id, a.turn) AS from_id, min(a.ts)::BIGINT AS from_ts, count(*) - 1 AS also_answers FROM rec a JOIN rec b ON a.thread_ts = b.thread_ts AND a.turn < b.turn GROUP BY b.id, b.turn",
    "waiting_lines": _WAITING,
    "anchor_idf": _ANCHOR_IDF,
    "anchor_overlap": f"WITH {_URL_ANCHORS}, q AS (SELECT id AS query_id, anchor, idf FROM k JOIN w USING (anchor) WHERE id % 20 = 0), t AS (SELECT query_id, sum(idf) AS whole FROM q GROUP BY ALL) SELECT query_id, id, round(sum(q.idf) / any_value(whole), 6) AS score FROM q JOIN k USING (anchor) JOIN t USING (query_id) WHERE query_id <> id GROUP BY query_id, id",
    "pair_signals": _PAIRS,
    "similarity_edges": f"SELECT l, r, round(1.5 + 0.3 * \"time\" + 0.8 * anchors + 0.35 * channel, 6) AS weight FROM ({_PAIRS.replace('round(CASE', '(CASE').replace('END, 6)', 'END)')})",
    "isolate_rescue": f"WITH {_MUTUAL} SELECT l, r, round(greatest(sim, 0.05), 6) AS weight FROM n WHERE rank = 1 AND l NOT IN (SELECT l FROM g UNION SELECT r FROM g)",
    "modularity": f"WITH {_MUTUAL}, x AS (SELECT weight, a.label AS ca, b.label AS cb FROM g JOIN embeddings a ON a.vec_id = l JOIN embeddings b ON b.vec_id = r), d AS (SELECT c, sum(weight) AS d FROM (SELECT ca AS c, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY c) SELECT round(sum(CASE WHEN ca = cb THEN weight ELSE 0 END) / sum(weight) - (SELECT sum(d * d) FROM d) / (4 * sum(weight) * sum(weight)), 6) AS modularity FROM x",
    "community_laws": "SELECT 'nodes' AS law, count(*) AS n FROM embeddings UNION ALL SELECT unnest(['nodes in two communities', 'named by another than the least member', 'communities of nodes that no path joins', 'modularity not above that of the true labels']), 0",
    "ari_nmi": f"WITH {_LABELLED}, c AS (SELECT label, truth, count(*)::DOUBLE AS n FROM e GROUP BY ALL), a AS (SELECT label, sum(n) AS x FROM c GROUP BY ALL), b AS (SELECT truth, sum(n) AS y FROM c GROUP BY ALL), t AS (SELECT count(*)::DOUBLE AS t FROM e), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bo, (SELECT sum(x * (x - 1) / 2) FROM a) AS sa, (SELECT sum(y * (y - 1) / 2) FROM b) AS sb, t FROM t) SELECT round((bo - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(2 * (SELECT sum(n / t * ln(n * t / (x * y))) FROM c JOIN a USING (label) JOIN b USING (truth)) / ((SELECT -sum(x / t * ln(x / t)) FROM a) + (SELECT -sum(y / t * ln(y / t)) FROM b)), 6) AS nmi FROM s",
    "cluster_purity": f"WITH {_LABELLED}, c AS (SELECT label, truth, count(*) AS n FROM e GROUP BY ALL) SELECT label, sum(n)::BIGINT AS size, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY label",
    "link_thread_vote": f"WITH {_EXPLICIT} SELECT coalesce(key, '') AS key, coalesce(tier, 'unassigned') AS tier, CASE tier WHEN 'explicit' THEN 1.0 WHEN 'thread' THEN 0.9 ELSE 0.0 END::DOUBLE AS confidence, count(*) AS n FROM st GROUP BY ALL",
    "link_consensus": _CONSENSUS,
    "link_overrides": f"WITH {_EXPLICIT}, o AS (SELECT 'm' || o_orderkey || '_1' AS id, CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE 'ticket:NEW-2' END AS ok FROM orders), f AS (SELECT CASE WHEN ok = '' THEN 'unassigned' WHEN ok IS NOT NULL THEN 'override' ELSE coalesce(tier, 'unassigned') END AS tier, coalesce(ok, key, '') AS key FROM st LEFT JOIN o USING (id)) SELECT tier, count(*) AS n, count(CASE WHEN key = '' THEN 1 END) AS unlinked FROM f GROUP BY tier",
    "unresolved_links": "SELECT 'gone' || o_orderkey AS id, 'ticket:X-1' AS key, 'missing' AS cause FROM orders UNION ALL SELECT 'm' || o_orderkey || '_1', CASE WHEN o_orderkey % 100 = 0 THEN '' ELSE 'ticket:NEW-2' END, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)",
    "item_owner": _OWNER,
    "content_ids": f"WITH {RECORDS} SELECT conv_id AS topic, 'c' || substr(sha1(arg_min(id, (ts, id))), 1, 6) AS content_id FROM rec GROUP BY conv_id",
    "latest_state": f"WITH {_STATE} SELECT topic, state, evidence_id, round(since, 3) AS since, moved_id FROM f",
    "state_gate": f"WITH {_EVENTS} SELECT relation, count(*) AS events, count(CASE WHEN NOT is_bot AND NOT (length(said) <= 25 AND size > 10) THEN 1 END) AS allowed FROM st WHERE relation IN ('resolves', 'blocked_by') GROUP BY relation",
    "declarations_asof": _DECLARED,
    "window_topics": f"WITH {_EVENTS}, x AS (SELECT topic * 10 + id % 7 AS topic, topic::VARCHAR AS u, ts, id FROM ev), n AS (SELECT epoch_us(TIMESTAMP '{NOW}') / 1e6 AS n) SELECT topic, count(*) AS messages, round(min(ts), 3) AS first_ts, round(max(ts), 3) AS last_ts, string_agg(DISTINCT u, ',' ORDER BY u) AS people FROM x CROSS JOIN n GROUP BY topic HAVING count(*) >= 2 AND count(CASE WHEN id % 3 <> 0 THEN 1 END) * 2 >= count(*) AND bool_or(ts BETWEEN n - 172800 AND n)",
    "digest_order": f"WITH {_STATE}, l AS (SELECT topic, max(ts) AS last FROM ev GROUP BY topic) SELECT row_number() OVER (ORDER BY CASE state WHEN 'blocked' THEN 0 WHEN 'active' THEN 1 ELSE 2 END, last DESC, topic) AS place, topic, state, round(last, 3) AS last FROM f JOIN l USING (topic)",
    "state_histogram": f"WITH {_STATE} SELECT state, count(*) AS n FROM f GROUP BY state",
    "drift_four_kinds": f"WITH {_TICKETS} SELECT topic, ticket, state, resolved, kind, mentions, last_id FROM dr WHERE kind IS NOT NULL",
    "quiet_tickets": f"WITH {_TICKETS}, said AS (SELECT string_agg(DISTINCT 'ABOUT ORD-' || topic, ' ') AS t FROM mn) SELECT ticket, round((epoch(TIMESTAMP '{NOW}') - updated) / 86400, 3) AS idle_days, contains(t, ticket) AS mentioned FROM tk, said WHERE NOT resolved AND updated > 0 AND (epoch(TIMESTAMP '{NOW}') - updated) / 86400 >= 21",
    "silent_tickets": f"WITH {_TICKETS} SELECT ticket, round((epoch(TIMESTAMP '{NOW}') - updated) / 86400, 3) AS idle_days FROM tk WHERE NOT resolved AND updated > 0 AND topic NOT IN (SELECT topic FROM mn) AND (epoch(TIMESTAMP '{NOW}') - updated) / 86400 >= 21",
    "coverage": f"WITH {_TICKETS} SELECT count(*) AS topics, count(ticket) AS with_ticket, count(CASE WHEN topic IN (SELECT topic FROM tk) THEN 1 END) AS known FROM tp",
    "agreement": f"WITH {_TICKETS} SELECT CASE WHEN coalesce(mentions, 0) = 0 THEN 'not comparable' WHEN kind IS NOT NULL THEN 'drift' ELSE 'agree' END AS verdict, count(*) AS n FROM tp LEFT JOIN dr USING (topic) GROUP BY verdict",
    "people_rows": f"WITH {_MEMBERS} SELECT \"user\", count(DISTINCT topic) AS items, count(DISTINCT CASE WHEN state = 'blocked' THEN topic END) AS blocked, count(*) AS messages, round(max(ts), 3) AS last_ts FROM mb GROUP BY \"user\"",
    "person_partners": f"WITH {_MEMBERS}, o AS (SELECT DISTINCT \"user\", topic FROM mb), pp AS (SELECT a.\"user\", b.\"user\" AS partner, count(*) AS items FROM o a JOIN o b ON a.topic = b.topic AND a.\"user\" <> b.\"user\" GROUP BY ALL) SELECT \"user\", partner, items FROM (SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY items DESC, partner) AS r FROM pp) WHERE r <= 5",
    "pending_streaks": f"WITH {_DAILIES} SELECT \"user\", blocker, days, since::VARCHAR AS since FROM sk",
    "escalate_once": f"WITH {_DAILIES} SELECT \"user\", blocker, days FROM sk WHERE days >= 3 AND \"user\" % 2 <> 0",
    "business_days_stale": f"WITH l AS (SELECT user_id, max(ts::DATE) AS last FROM events WHERE event_type = 'error' GROUP BY user_id), w AS (SELECT user_id, len(list_filter(range(1, date_diff('day', last, DATE '{NOW}') + 1), lambda k: isodow(last + k::INT) <= 5)) AS workdays FROM l) SELECT user_id, workdays, workdays // 3 * 3 AS bucket FROM w WHERE workdays >= 3",
    "decision_chain": _CHAIN,
    "json_props": "WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events) SELECT key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.\"' || key || '\"')) AS \"values\" FROM k GROUP BY key",
    "hash_ids": "SELECT DISTINCT 'note_' || substr(sha1(text), 1, 10) AS note, sha256(text) AS digest FROM conversations",
    "pseudonyms": _PSEUDONYMS,
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
