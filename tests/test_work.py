import datetime as dt
import random

import pytest
from colloquy.functions.encode import embedded
from colloquy.operators import decisions, drift, evaluation, fusion, graphs, louvain, relations, signals, state, upserts
from colloquy.plans import digest, retrieve
from colloquy.sources import records as R
from colloquy.sources import tracker, transcripts
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def chat(spark, said):
    """said: (id, ts, user, text)."""
    return spark.createDataFrame([(i, k, float(t) if t is not None else None, "T", u, "C1", x, "slack", False, None) for k, (i, t, u, x) in enumerate(said)], "id string, pos int, ts double, thread_ts string, user string, channel_id string, text string, source string, is_bot boolean, analysis_text string")


def typed(spark, said):
    r = chat(spark, said)
    pairs = relations.by_time(signals.thread_pairs(r), r.select("id", "ts", "pos"))
    return r, relations.typed(pairs, relations.read(r))


def test_relation_rules(spark):
    _, got = typed(spark, [("a", 1, "U1", "can you check REV-12?"), ("b", 2, "U2", "yes, it is fine"), ("c", 3, "U3", "intro\nblocked on something"), ("d", 4, "U1", "first\nREV-12 is fixed"), ("e", 5, "U9", "any update on this"), ("f", 6, "U2", "hello all\nwaiting for U3 there")])
    found = {(r.source, r.target): r.relation for r in got.collect()}
    assert found["a", "b"] == "answers" and found["a", "d"] == "resolves" and found["b", "d"] == "same_topic"
    assert found["a", "c"] == "same_topic" and found["a", "e"] == "follows_up"
    assert found["c", "f"] == "blocked_by" and found["a", "f"] == "same_topic"


def test_state_and_its_gate(spark):
    said = [(str(i), i, "U1", f"message number {i} of the topic") for i in range(12)]
    r = chat(spark, said)
    topics = r.select("id", F.lit(1).alias("topic"), "ts", "is_bot", F.col("text").alias("said"), "user")
    rel = lambda *x: spark.createDataFrame([(s, t, n, "cue") for s, t, n in x], "source string, target string, relation string, evidence string")
    one = lambda links, tops=topics: state.inferred(links, tops).first()
    blocked = one(rel(("0", "5", "blocked_by"), ("0", "7", "follows_up")))
    assert (blocked.state, blocked.evidence_id, blocked.moved_id) == ("blocked", "5", "7")
    assert one(rel(("0", "5", "blocked_by"), ("0", "8", "resolves"))).state == "resolved"
    short = topics.withColumn("said", F.when(F.col("id") == "8", "done").otherwise(F.col("said")))
    assert one(rel(("0", "5", "blocked_by"), ("0", "8", "resolves")), short).state == "blocked"
    assert one(rel(("0", "8", "resolves")), short.where("id in ('0', '8')")).state == "resolved"
    bot = topics.withColumn("is_bot", F.col("id") == "8")
    assert one(rel(("0", "8", "resolves")), bot).state == "active"
    assert one(rel(("0", "8", "same_topic"))).state == "active"


def test_declarations_stand_until_their_author_clears_them(spark):
    topics = spark.createDataFrame([("a", 1, "U1", 10.0), ("b", 1, "U2", 20.0), ("c", 2, "U1", 5.0)], "id string, topic int, user string, ts double")
    states = spark.createDataFrame([(1, "resolved", "x", 30.0), (2, "active", None, None)], "topic int, state string, evidence_id string, since double")
    said = spark.createDataFrame([("a", ["waiting for data"]), ("c", ["no access yet"])], "id string, answers array<string>")
    clear = lambda *x: spark.createDataFrame(list(x), "user string, cleared double")
    assert rows(state.with_declarations(states, topics, said, clear(("U2", 99.0))), "topic", "state", "evidence_id") == [(1, "blocked", "a"), (2, "blocked", "c")]
    assert rows(state.with_declarations(states, topics, said, clear(("U1", 7.0))), "topic", "state") == [(1, "blocked"), (2, "active")]


def test_links(spark):
    said = [("1", "t1", "C1", "about REV-1"), ("2", "t1", "C1", "reply"), ("3", "", "C2", "MOB-2 waits for REV-1"), ("4", "", "C1", "UTF-8 text"), ("5", "", "C1", "REV-9"), ("6", "", "C1", "loose")]
    r = spark.createDataFrame([(i, k, t, c, x) for k, (i, t, c, x) in enumerate(said)], "id string, pos int, thread_ts string, channel_id string, text string")
    projects = tracker.channel_projects(spark, "MOB (Mobile)=C2; broken; =C9")
    clusters = spark.createDataFrame([("1", 0), ("2", 0), ("4", 0), ("5", 1), ("6", 2)], "id string, label int")
    over = spark.createDataFrame([("5", ""), ("6", "ticket:REV-7"), ("zz", "ticket:REV-7")], "id string, key string")
    got = {r.id: (r.key, r.tier) for r in relations.link(r, clusters, over, projects=projects).collect()}
    assert got == {"1": ("ticket:REV-1", "explicit"), "2": ("ticket:REV-1", "thread"), "3": ("ticket:MOB-2", "explicit"), "4": ("ticket:REV-1", "consensus"), "5": ("", "unassigned"), "6": ("ticket:REV-7", "override")}
    assert rows(relations.unresolved(over, r), "id", "cause") == [("zz", "missing")]
    assert rows(relations.trusted_prefixes(r), "prefix") == [("MOB",), ("REV",)]
    assert rows(relations.trusted_prefixes(r, [" rev "]), "prefix") == [("REV",)]


def test_timeline_keeps_the_earliest_partner(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "id string, ts double")
    rel = spark.createDataFrame([("b", "c", "resolves"), ("a", "c", "resolves"), ("a", "b", "same_topic")], "source string, target string, relation string")
    assert rows(state.timeline(rel, r), "relation", "to_id", "from_id", "also_answers") == [("resolves", "c", "a", 1)]


def test_drift_needs_a_mention(spark):
    topics = spark.createDataFrame([(1, "REV-1", "blocked"), (2, "REV-2", "active"), (3, "REV-3", "resolved"), (4, "REV-4", "blocked")], "topic int, ticket string, state string")
    tickets = spark.createDataFrame([("REV-1", True, 100.0), ("REV-2", True, 100.0), ("REV-3", False, 100.0), ("REV-4", False, 100.0)], "ticket string, resolved boolean, updated double")
    said = spark.createDataFrame([(1, "REV-1", "m1", 50.0, "rev-1 is stuck", False), (2, "REV-2", "m2", 100.0 + 7 * 3600, "REV-2 again", False), (3, "REV-3", "m3", 60.0, "REV-3 done", False), (4, "REV-4", "m4", 60.0, "REV-4", True)], "topic int, ticket string, id string, ts double, text string, tracker boolean")
    judged = drift.detect(topics, tickets, drift.mentions(said))
    assert rows(judged, "topic", "kind") == [(1, "ticket_closed_but_slack_blocked"), (2, "ticket_closed_but_talking"), (3, "slack_resolved_but_ticket_open")]
    assert rows(drift.agreement(judged, topics), "topic", "verdict")[3] == (4, "not comparable")
    assert rows(drift.silent(tickets, said.where("not tracker").select("ticket"), 100.0 + 30 * 86400), "ticket") == [("REV-4",)]


def test_streaks_skip_days_that_were_not_collected(spark):
    day = lambda n: dt.date(2026, 8, n)
    blockers = spark.createDataFrame([(day(3), "U1", "api"), (day(4), "U1", "api"), (day(7), "U1", "api"), (day(3), "U2", "db"), (day(7), "U2", "db"), (day(4), "U3", "x")], "date date, user string, blocker string")
    days = spark.createDataFrame([(day(3),), (day(4),), (day(7),)], "date date")
    found = drift.streaks(blockers, days)
    assert rows(found, "user", "days", "since") == [("U1", 3, day(3)), ("U2", 1, day(7))]
    told = spark.createDataFrame([("U1", "api")], "user string, blocker string")
    assert drift.escalations(found, told, 3).count() == 0 and drift.escalations(found, told.where("false"), 3).count() == 1


def test_decisions(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "id string, superseded_by string")
    got = {r.start: [] for r in d.select(F.col("id").alias("start")).collect()}
    for r in decisions.chains(d).orderBy("start", "step").collect():
        got[r.start].append(r.id)
    assert got == {"a": ["a", "b", "c"], "b": ["b", "c"], "c": ["c"], "x": ["x", "y"], "y": ["y", "x"]}
    made = spark.createDataFrame([("a", 0, 1.0, "ship on friday", "t"), ("b", 1, 2.0, "ship on monday", "t"), ("c", 2, 3.0, "ship on sunday", "t")], "id string, pos int, at double, text string, topic string")
    assert rows(decisions.superseded(made), "id", "superseded_by") == [("a", "b"), ("b", "c")]


def test_upserts(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 8)], "id string, v int")
    assert sorted(map(tuple, upserts.upsert(old, new).collect()), key=str) == sorted([("a", 1), ("b", 9), ("c", 8), (None, 3)], key=str)
    assert rows(upserts.insert_absent(old.where("id is not null"), new), "id", "v") == [("a", 1), ("b", 2), ("c", 8)]
    meet = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(upserts.upsert_meeting(meet("mtg_a_1", "mtg_a_2", "mtg_b_1"), meet("mtg_a_9")), "id") == [("mtg_a_9",), ("mtg_b_1",)]
    src = spark.createDataFrame([("slack",), ("meeting",), (None,)], "source string")
    assert upserts.foreign_sources(src, ["slack"]) == ["", "meeting"]
    store = upserts.Versions(spark, str(tmp_path / "store"))
    assert store.read() is None
    store.write(old)
    store.write(upserts.upsert(store.read(), new))
    assert store.read().count() == 4


def test_fusion(spark):
    s = spark.createDataFrame([(1, i, "a", v) for i, v in ((1, 5.0), (2, 5.0), (3, 1.0))], "query_id int, id int, stage string, score double")
    ranked = s.withColumn("rank", fusion.competition_rank(F.col("score"), "query_id", "stage"))
    assert rows(ranked, "id", "rank") == [(1, 1), (2, 1), (3, 3)]
    assert [round(x, 6) for _, x in rows(fusion.reciprocal(ranked, {"a": 2.0}), "id", "score")] == [round(2 / 61, 6)] * 2 + [round(2 / 63, 6)]
    flat = s.withColumn("score", F.lit(2.0))
    assert {r.score for r in fusion.z_scores(flat).collect()} == {0.0}
    again = spark.createDataFrame([(1, 3, 7.0)], "query_id int, id int, score double")
    assert rows(fusion.spliced(s.select("query_id", "id", "score"), again), "id", "score") == [(1, 5.0), (2, 5.0), (3, 6.0)]


def test_communities_and_measures(spark):
    links = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1), (30, 31, 1.0)]
    graph = spark.createDataFrame(links, "l bigint, r bigint, weight double")
    nodes = spark.createDataFrame([(i,) for i in (*range(5), *range(10, 15), 30, 31, 99)], "id bigint")
    parts = graphs.components(graph)
    assert {r.id: r.component for r in parts.collect()} == {i: 0 for i in (*range(5), *range(10, 15))} | {30: 30, 31: 30}
    found = louvain.communities(nodes, graph, 1.0)
    assert {r.id: r.community for r in found.collect()} == {i: 0 for i in range(5)} | {i: 10 for i in range(10, 15)} | {30: 30, 31: 30, 99: 99}
    assert {r.label: r.size for r in signals.size_ranked(found).collect()} == {0: 5, 1: 5, 2: 2, 3: 1}
    both = found.select(F.col("community").alias("label"), F.col("community").alias("truth"))
    got = signals.agreement(both).first()
    assert got.ari == pytest.approx(1) and got.nmi == pytest.approx(1)
    assert signals.modularity(graph, found.select("id", F.col("community").alias("label"))).first()[0] > signals.modularity(graph, nodes.select("id", F.lit(1).alias("label"))).first()[0]


def test_communities_in_rounds_are_as_good_as_node_by_node(spark):
    """Parallel moves against the sequential fold on a graph with planted groups, repeated edges, loops and a hub."""
    rnd = random.Random(3)
    links = []
    for _ in range(6000):
        a = rnd.randrange(1500)
        b = a // 30 * 30 + rnd.randrange(30) if rnd.random() < 0.7 else rnd.randrange(1500)
        links.append((a, b, round(rnd.random() + 0.05, 3)))
    links += [(0, i, 0.05) for i in range(1, 1500)] + [(None, 3, 1.0), (3, 4, None), (5, 6, -1.0)]
    graph = spark.createDataFrame(links, "l bigint, r bigint, weight double")
    nodes = spark.range(1502).toDF("id")
    found = {r.id: r.community for r in louvain.communities(nodes, graph, 1.0, fold_edges=2000).collect()}
    assert set(found) == set(range(1502)) and all(min(i for i, c in found.items() if c == x) == x for x in set(found.values()))
    assert found[1500] == 1500 and found[1501] == 1501

    weight: dict = {}
    for a, b, w in links:
        if a is not None and w is not None and w > 0:
            weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0) + round(w * louvain.UNIT)
    whole = 2 * sum(weight.values())

    def quality(label):
        total: dict = {}
        for (a, b), w in weight.items():
            total[label[a]] = total.get(label[a], 0) + w
            total[label[b]] = total.get(label[b], 0) + w
        return 2 * sum(w for (a, b), w in weight.items() if label[a] == label[b]) / whole - sum((t / whole) ** 2 for t in total.values())

    both = [(a, b, w) for (a, b), w in weight.items() if a != b]
    exact = louvain.folded(both + [(b, a, w) for a, b, w in both], {i: weight.get((i, i), 0) for i in range(1500)}, float(whole), 1.0)
    assert quality(found) > 0.99 * quality(exact) > 0.3


def test_measures_by_hand(spark):
    ranks = spark.createDataFrame([(1, i, i) for i in range(1, 6)] + [(2, 9, 1)], "query_id int, id int, rank int")
    truth = spark.createDataFrame([(1, 2), (1, 4), (1, 77), (2, 5)], "query_id int, id int")
    one, two = evaluation.measures(ranks, truth, 3).orderBy("query_id").collect()
    assert one.recall == pytest.approx(1 / 3) and one.ceiling == 1 and one.rr == 0.5 and one.ap == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert two.rr == 0 and two.first_hit == 2
    assert rows(evaluation.without(ranks, spark.createDataFrame([(1, 1)], "query_id int, id int")).where("query_id = 1"), "id", "rank") == [(2, 1), (3, 2), (4, 3), (5, 4)]


def test_transcripts(spark):
    more = spark.createDataFrame([("b.vtt", "WEBVTT\n\nNOTE 00:00:09.000 --> 00:00:10.000\nabc-1\n00:00:01.000 --> 00:00:02.000\n<v Ana>\nfirst words\n\nstill Ana\nBen: not a name here\n<v Cy>but this is</v>\n\n00:05.5 --> 00:06.0\nno one"), ("c.json", '[{"start": null, "offset": 9, "text": "x"}, 3, {"start": "1.5", "user": "U", "text": "", "content": 7}]'), ("d.txt", "http://x.y\n\nAna: hi")], "path string, text string")
    assert rows(transcripts.utterances(more), "path", "offset", "user", "text") == [
        ("b.vtt", 1.0, "Ana", "first words"), ("b.vtt", 1.0, "Cy", "still Ana Ben: not a name here but this is"), ("b.vtt", 5.5, "unknown", "no one"),
        ("c.json", 0.0, "unknown", "x"), ("c.json", 1.5, "U", "7"), ("d.txt", 0.0, "unknown", "http://x.y"), ("d.txt", 40.0, "Ana", "hi"),
    ]
    with pytest.raises(Exception, match="a JSON transcript is a list"):
        transcripts.utterances(spark.createDataFrame([("e.json", '{"text": "x"}')], "path string, text string")).collect()
    files = spark.createDataFrame([("a.vtt", "WEBVTT\n\n7\n00:01:02.500 --> 00:01:04.000\n<v Ana>Hello <b>all</b>\nmore\n\n01:00:00.000 --> 01:00:01.000\nBen: bye\n"), ("b.txt", "Ana: one\ntwo"), ("c", '[{"speaker": "X", "offset": "3", "content": "hi"}, {"text": ""}]')], "path string, text string")
    got = rows(transcripts.utterances(files), "path", "offset", "user", "text")
    assert got == [("a.vtt", 62.5, "Ana", "Hello all more"), ("a.vtt", 3600.0, "Ben", "bye"), ("b.txt", 0.0, "Ana", "one"), ("b.txt", 20.0, "Ana", "two"), ("c", 3.0, "X", "hi")]
    assert rows(R.speaker_lines(files.where("path = 'b.txt'")), "user", "text") == [("Ana", "one"), ("Ana", "two")]


def test_paste(spark):
    text = "preamble\nNok  [2:21 PM]\nimage.png 2 repliesNok Jai  [Today at 11:59 PM] late\nit is at [noon]\n[12:01 AM]\nafter midnight (edited)\n:+1: 3\nAug 25th\nBee  [9:00 AM]\n[BUG] broken"

    def parsed(text):
        found = transcripts.pasted(spark.createDataFrame([("t", dt.date(2026, 8, 19), text)], "title string, day date, text string")).orderBy("pos").collect()
        return [r.text for r in found if r.skipped], [(str(dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r.ts)), r.user, r.text) for r in found if not r.skipped]

    skipped, messages = parsed(text)
    assert skipped == ["preamble"]
    assert messages == [("2026-08-19 23:59:00", "Nok Jai", "late\nit is at [noon]"), ("2026-08-20 00:01:00", "Nok Jai", "after midnight"), ("2026-08-25 09:00:00", "Bee", "[BUG] broken")]
    # a named day that lies before the last clock; a day line alone goes on for the last speaker; times that are none
    _, messages = parsed("Ann  [11:00 PM] a\nToday\nstill Ann\n[10:00 PM] b\nBo  [13:05] c\nBo, no.  [13:06]\n[25:00] x\n[0:30 AM] y\nYesterday\nCy APP  [12:00 AM] d\nview thread\n3 replies")
    assert messages == [
        ("2026-08-19 23:00:00", "Ann", "a"),
        ("2026-08-19 23:00:00", "Ann", "still Ann"),
        ("2026-08-20 22:00:00", "Ann", "b"),
        ("2026-08-21 13:05:00", "Bo", "c\nBo, no.  [13:06]\n[25:00] x\n[0:30 AM] y"),
        ("2026-08-19 00:00:00", "Cy APP", "d"),
    ]


def test_paste_records_are_stable(spark):
    files = spark.createDataFrame([("Chat", dt.date(2026, 8, 19), "Ana  [9:00 AM]\none\nAna  [9:00 AM]\ntwo\n")], "title string, day date, text string")
    names = spark.createDataFrame([("ana", "U1"), ("Ben", "U2"), ("ben", "U3")], "name string, user string")
    a, b = (transcripts.paste_records(transcripts.pasted(files), names).orderBy("ts").collect() for _ in range(2))
    assert [r.id for r in a] == [r.id for r in b] and [r.user for r in a] == ["U1", "U1"] and a[1].ts - a[0].ts == 1


def test_runs_are_measured_from_their_beginning(spark):
    said = spark.createDataFrame([("t", "A", 0.0, "a"), ("t", "A", 40.0, "b"), ("t", "A", 80.0, "c"), ("t", "B", 81.0, "d")], "thread string, user string, ts double, text string")
    assert rows(R.merged_runs(said, "thread", 45.0), "ts", "text", "n") == [(0.0, "a b", 2), (80.0, "c", 1), (81.0, "d", 1)]


def test_export(spark):
    raw = spark.createDataFrame([("1.0", None, "U1", "the <https://a.b|api> is broken", None, None, 2, None, [("2.0", "1.0", "U2", "ok", None, None, None), ("3.0", "1.0", None, "fixed &amp; merged", None, "B1", None)]), ("4.0", None, "U3", "has joined", "channel_join", None, 0, None, None)], R.EXPORT)
    got = R.from_export(raw, "C1")
    assert rows(got, "id", "user", "text") == [("msg_C1_1.0", "U1", "the api is broken"), ("msg_C1_3.0", "B1", "fixed & merged")]
    assert rows(R.rollups(got), "id", "text") == [("thread_C1_1.0", "the api is broken\nfixed & merged")]
    flat = spark.createDataFrame([("1", None, "p"), ("2", "1", "r"), ("9", "8", "orphan")], "ts string, parent_ts string, text string")
    assert {r.ts: len(r.replies or []) for r in R.regrouped(flat).collect()} == {"1": 1, "9": 0}
    corpus = spark.createDataFrame([("a", "slack", "C1"), ("b", "slack_thread", "C1"), ("c", None, None), ("d", "slack", "C9")], "id string, source string, channel_id string")
    assert rows(R.read_corpus(corpus, skipped=["C9"]), "id") == [("a",), ("c",)]


def test_tickets(spark):
    data = [("rev-1", "Title one", "# h\nshort\nA longer line of prose here", None, 2000, 1000, [("Any", ("Open", "x.StateBundleElement"))]), ("REV-2", "Other", None, 5000, 9000, 1000, [("State", ("no", "Enum")), ("S", ("Done", "StateBundleElement"))]), ("REV-2", "again", None, None, 1, 1, [])]
    t = tracker.tickets(spark.createDataFrame(data[:2], tracker.ROW))
    assert rows(t, "ticket", "text", "state", "resolved", "updated") == [("REV-1", "Title one A longer line of prose here", "Open", False, 2.0), ("REV-2", "Other", "Done", True, 9.0)]
    assert tracker.tickets(spark.createDataFrame(data, tracker.ROW)).count() == 2
    assert rows(tracker.searched(t, "rev-2"), "ticket") == [("REV-2",)] and rows(tracker.searched(t, "1"), "ticket") == [("REV-1",)] and rows(tracker.searched(t, "title"), "ticket") == [("REV-1",)]


def test_search_presets_and_gate(spark):
    r = chat(spark, [("a", 1, "U1", "the login page is broken"), ("b", 2, "U2", "lunch at noon"), ("c", 3, "U1", "login fails with a timeout")])
    corpus = retrieve.Corpus(r, embedded(r.select("id", "text"))[0])
    asked = spark.createDataFrame([("q", "login broken"), ("z", "qqqq")], "query_id string, text string")
    asked = asked.join(embedded(asked.withColumnRenamed("query_id", "id"))[0].select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    for preset in ("dense", "lexical", "hybrid", "hybrid-anchors", "hybrid-jaccard"):
        assert retrieve.ranked(corpus, asked, preset, 1).where("query_id = 'q'").first().id == "a"
    known = retrieve.relevance(corpus, asked)
    assert {x.query_id for x in retrieve.gated(retrieve.ranked(corpus, asked), known, 0.3).collect()} == {"q"}
    assert "a" not in {x.id for x in retrieve.related(corpus, spark.createDataFrame([("a",)], "id string")).collect()}


def test_vectors_are_encoded_once(spark):
    r = spark.createDataFrame([("a", "same words"), ("b", "same words"), ("c", "others")], "id string, text string")
    _, cache = embedded(r)
    assert cache.count() == 2
    again, kept = embedded(r.where("id != 'c'"), cache=cache.withColumn("v", F.array(F.lit(7.0))))
    assert {tuple(x.v) for x in again.collect()} == {(7.0,)} and kept.count() == 1


def test_digest(spark):
    r = chat(spark, [("a", 1, "U1", "can we ship REV-1421 now?"), ("b", 2, "U2", "REV-1421 is blocked by the api"), ("c", 3, "U1", "any update on REV-1421")])
    built = digest.build(r, 0.0, 10.0, resolution=0.5, projects=["REV"])
    top = built.topics.first()
    assert (top.item_id, top.state, top.evidence_id, top.messages) == ("REV-1421", "blocked", "b", 3)
    whole = r.join(built.members, "id")
    told = digest.summaries(digest.brief(whole, 0.0, 2), built.topics).first()
    assert told.citations == ["c", "b"] and not told.unverified
    assert digest.build(r, 50.0, 60.0, resolution=0.5, projects=["REV"]).topics.count() == 0


def test_of_lines_with_one_time_and_number_the_tables_first_tells_a_topics_state(spark, tmp_path):
    """SQL leaves the tie open and takes the row that comes first; the flag's own order must not matter."""
    from colloquy.plans import work

    at, before = dt.datetime(1998, 1, 2), dt.datetime(1997, 1, 2)
    lines = [(1, 1, before, "A"), (1, 2, at, "N"), (1, 2, at, "R"), (2, 2, at, "R"), (2, 1, before, "N"), (2, 2, at, "N"), (3, 1, at, "A"), (3, 2, at, "R")]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_shipdate timestamp, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "O", before) for k in (1, 2, 3)], "o_orderkey bigint, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.topic: r.state for r in work._tickets(spark, str(tmp_path))[0].collect()} == {1: "active", 2: "blocked", 3: "blocked"}
    assert {r.topic: r.kind for r in work.drift_four_kinds(spark, str(tmp_path)).collect()} == {2: "slack_blocked_but_ticket_open", 3: "slack_blocked_but_ticket_open"}


def test_a_text_whose_tokens_cancel_each_other_out_is_still_told_from_one_without_any(spark, tmp_path):
    """Two tokens of one component and opposite signs: the search's encoder gives zeros, as its SQL does, the cache's a unit vector."""
    import hashlib

    from colloquy.functions.encode import hashed
    from colloquy.plans import flows

    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:6], 16)
    names = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)]
    other = next(t for t in names if place(t) % 64 == place("waa") % 64 and (place(t) >= 1 << 23) != (place("waa") >= 1 << 23))
    spark.createDataFrame([(1, 0, f"waa {other}"), (1, 1, "waa"), (2, 0, "..."), (2, 1, None)], "conv_id bigint, turn bigint, text string").withColumn("role", F.lit("user")).write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r.id: r.norm for r in flows.embed_cache(spark, str(tmp_path)).collect()} == {"msg_1_0": 1.0, "msg_1_1": 1.0, "msg_2_0": 0.0, "msg_2_1": 0.0}
    assert set(spark.createDataFrame([(f"waa {other}",)], "t string").select(hashed(F.col("t")).alias("v")).first().v) == {0.0}


def test_records_of_equal_anchors_are_compared_once(spark):
    held = {k: ({"a", "b"} if k % 3 == 0 else {"b"} if k % 3 == 1 else {"c", f"own{k}"}) for k in range(60)}
    table = spark.createDataFrame([(k, a) for k, s in held.items() for a in s], "id long, anchor string")
    idfs = signals.anchor_idf(table, len(held))
    asked = table.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = signals.anchor_overlap(table, idfs, asked)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # no row for a pair is shuffled or summed up
    idf = {r.anchor: r.idf for r in idfs.collect()}
    want = {(q, k): round(sum(idf[a] for a in held[q] & held[k]) / sum(idf[a] for a in held[q]), 9) for q in range(0, 60, 20) for k in held if held[q] & held[k]}
    assert {(r.query_id, r.id): round(r.score, 9) for r in found.collect()} == want
