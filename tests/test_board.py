import json
import tracemalloc

import pytest
from colloquy.functions import when
from colloquy.functions.encode import embedded
from colloquy.operators import dailies, decisions, items, ledger, upserts
from colloquy.plans import retrieve
from colloquy.sources import chat, corpus
from pyspark.sql import functions as F


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=str)


def test_calls_wait_as_long_as_the_service_says():
    waits, left = [], [3]

    def ask():
        if left[0]:
            left[0] -= 1
            raise chat.Limited(2.5)
        return {"ok": True}

    assert chat.called(ask, waits.append) == {"ok": True} and waits == [2.5] * 3
    left[0] = 99
    with pytest.raises(chat.Limited):
        chat.called(ask, lambda s: None)
    assert left[0] == 99 - chat.TRIES


def recorded(tmp_path, messages):
    for channel, some in messages.items():
        (tmp_path / f"channel={channel}").mkdir(exist_ok=True)
        (tmp_path / f"channel={channel}" / "a.json").write_text("\n".join(json.dumps(m) for m in some))
    return {"transport": "colloquy.sources.chat:recorded", "path": str(tmp_path), "page": "2"}


def test_chat_source(spark, tmp_path):
    talk = [{"ts": f"{i}.0", "user": "U1" if i % 2 else "ME", "text": f"m{i}"} for i in range(1, 6)]
    talk += [{"ts": "6.0", "thread_ts": "6.0", "user": "U2", "text": "parent", "reply_count": 2}, {"ts": "7.0", "thread_ts": "6.0", "user": "U1", "text": "reply"}, {"ts": "8.0", "thread_ts": "6.0", "user": "ME", "text": "own"}]
    options = recorded(tmp_path, {"C2": talk, "C1": [{"ts": "1.5", "user": "U9", "text": "other"}]}) | {"own": "ME"}
    spark.dataSource.register(chat.Chat)
    got = rows(spark.read.format("chat").options(**options).load(), "channel", "ts", "is_reply")
    assert got == [("C1", "1.5", False), ("C2", "1.0", False), ("C2", "3.0", False), ("C2", "5.0", False), ("C2", "6.0", False), ("C2", "7.0", True)]
    assert rows(spark.read.format("chat").options(**options, channels="C2", oldest="5.0").load(), "ts") == [("5.0",), ("6.0",), ("7.0",)]


def test_chat_stream_goes_on_in_each_channel(spark, tmp_path):
    def add(name, channel, *messages):
        (tmp_path / "in" / f"channel={channel}").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / f"channel={channel}" / f"{name}.json").write_text("\n".join(json.dumps(m) for m in messages))

    def run():
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / "out")), "channel", "ts")

    spark.dataSource.register(chat.Chat)
    add("a", "C1", {"ts": "10.0", "text": "old"}, {"ts": "20.0", "text": "head"}, {"ts": "21.0", "thread_ts": "20.0", "text": "reply"}, {"ts": "90.0", "text": "new"})
    add("a", "C2", {"ts": "5.0", "text": "quiet"})
    options = {"transport": "colloquy.sources.chat:recorded", "path": f"file:{tmp_path}/in", "page": "1", "span": "7", "lookback": "75"}
    stream = spark.readStream.format("chat").options(**options).load()
    assert run() == [("C1", "10.0"), ("C1", "20.0"), ("C1", "21.0"), ("C1", "90.0"), ("C2", "5.0")]
    # a late reply alone, one that is later than is looked back for, and a channel that wasn't there
    add("b", "C1", {"ts": "95.0", "thread_ts": "20.0", "text": "late reply"}, {"ts": "96.0", "thread_ts": "10.0", "text": "too late"})
    add("b", "C3", {"ts": "7.0", "text": "fresh"})
    once = {("C1", "10.0"), ("C1", "20.0"), ("C1", "21.0"), ("C1", "90.0"), ("C2", "5.0"), ("C1", "95.0"), ("C3", "7.0")}
    got = run()
    assert set(got) == once and got.count(("C1", "90.0")) == 2  # the boundary comes again
    assert run() == got  # nothing new, no batch
    reader = chat.Chat(options).streamReader(None)
    parts = reader.partitions({"C1": "90.0", "C2": "5.0"}, {"C1": "95.0", "C2": "5.0"})
    assert {p.channel for p in parts} == {"C1"} and 2 < len(parts) <= chat.RANGES and parts[-1].low == 15.0
    assert sorted(r[1] for p in parts for r in reader.read(p)) == ["90.0", "95.0"]


def test_chat_rows_as_people_wrote_them(spark, tmp_path):
    talk = [{"ts": "1.0", "user": "U1", "text": "hi", "reactions": [{"name": "eyes"}, {"name": "+1"}]}, {"ts": "2.0", "subtype": "channel_join", "text": "joined"}]
    talk += [{"ts": "3.0", "subtype": "thread_broadcast", "text": "told"}, {"ts": "4.0", "user": "U1", "text": ""}]
    options = recorded(tmp_path, {"C1": talk})
    spark.dataSource.register(chat.Chat)
    got = spark.read.format("chat").options(**options, subtypes="thread_broadcast", permalinks="true").load()
    assert rows(got, "ts", "reactions") == [("1.0", ["eyes", "+1"]), ("3.0", [])]
    assert got.where("permalink like '%channel=C1#1.0'").count() == 1
    assert spark.read.format("chat").options(**options).load().count() == 4


def test_corpus_files_are_checked(spark, tmp_path):
    def read(text):
        (tmp_path / "c.json").write_text(text)
        return corpus.read_records(spark, str(tmp_path / "c.json"))

    assert read('[{"id": "a", "text": "x"}, {"id": "b", "text": ""}]').count() == 2
    for text, said in (('{"id": 1}', "a list of records"), ("nonsense", "a list of records"), ('[{"id": "a", "text": "x"}, 3]', "record 1 "), ('[{"id": "a"}]', "record 0 ")):
        with pytest.raises(corpus.CorpusError, match=said):
            read(text)
    with pytest.raises(SystemExit, match="is not there"):
        corpus.or_exit(lambda: corpus.read_records(spark, str(tmp_path / "none.json")))
    some = spark.createDataFrame([("a", "x"), (None, "y")], "id string, text string")
    assert corpus.checked(some.where("id is not null")).count() == 1
    with pytest.raises(Exception, match="a record needs id and text"):
        corpus.checked(some).collect()


def test_names(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"U0123ABCD": "Nok", "U9": "Jai"}')
    known = chat.names(spark, str(tmp_path / "n.json"))
    said = spark.createDataFrame([("a", "@U0123ABCD and @U7777777A, a@U0123ABCD, U0123ABCD"), ("b", "none"), ("c", None)], "id string, text string")
    assert rows(chat.names_in_text(said, known)) == [("a", "@Nok and @U7777777A, a@Nok, U0123ABCD"), ("b", "none"), ("c", None)]
    assert rows(chat.names_in_text(said, known, lambda u: F.lit("Somebody")).where("id = 'a'"), "text") == [("@Nok and @Somebody, a@Nok, U0123ABCD",)]
    ids = spark.createDataFrame([("U0123ABCD",), ("Ubiquity",), ("X1234567",), ("U123",), ("B0_12345",)], "u string")
    assert rows(ids.where(items.is_chat_id(F.col("u")))) == [("B0_12345",), ("U0123ABCD",)]


def slow_ledger(messages):
    """Every message against every item so far."""
    import re

    def grams(text):
        bare = re.sub(r"\s+", "", text.lower())
        return {bare[i : i + 3] for i in range(len(bare) - 2)}

    keys, of, threads, new, out = [], {}, {}, 0, {}
    for id_, ts, thread, text in messages:
        g, named = grams(text), re.search(r"(?<!\w)[A-Z][A-Z0-9]{1,9}-\d{1,6}(?!\w)", text)
        likeness = [(len(g & of[k]) / max(1, len(g | of[k])), -i) for i, k in enumerate(keys)]
        best = max(likeness, default=(0, 0))
        if named:
            tier, key = "explicit", named[0]
        elif thread in threads:
            tier, key = "thread", threads[thread]
        elif best[0] >= ledger.ALIKE:
            tier, key = "alike", keys[-best[1]]
        elif len(text) > ledger.LONG:
            new += 1
            tier, key = "new", f"TAM-{new}"
        else:
            out[id_] = (None, None)
            continue
        if key not in of:
            keys.append(key)
            of[key] = set()
        of[key] |= g
        if tier in ("explicit", "new") or (tier == "alike" and not thread):
            threads[thread or ts] = key
        out[id_] = (key, tier)
    return out


def test_ledger_against_every_item(spark):
    import random

    rnd = random.Random(4)
    topics = [[f"{a}{b}" for a in ("ka", "lo", "mi") for b in rnd.sample(["nar", "pes", "tul", "vok", "zer"], 3)] for _ in range(5)]
    said = []
    for i in range(120):
        words = rnd.choice(topics)
        text = " ".join(rnd.choice(words) for _ in range(14 if i == 0 else rnd.choice([1, 3, 14])))
        if i % 9 == 8:
            text += f" REV-{i % 4}1"
        said.append((f"m{i}", f"{i}.0", f"{rnd.randint(0, i)}.0" if i % 5 == 0 else None, text))
    df = spark.createDataFrame([(a, "C1", k, float(k), t, x) for k, (a, ts, t, x) in enumerate(said)], "id string, channel string, pos int, at double, thread_ts string, text string").withColumn("ts", F.format_string("%.1f", "at"))
    got = {r.id: (r.item, r.tier) for r in ledger.assigned(df).collect()}
    assert got == slow_ledger(said) and {t for _, t in got.values()} == {"explicit", "thread", "alike", "new", None}
    found, none = ledger.built(df.withColumn("ts", F.col("at")))
    assert found.agg(F.sum("messages")).first()[0] + none.count() == 120


def test_chains_end_where_a_cycle_closes(spark):
    links = [(1, 2), (2, 3), (3, None), (4, 5), (5, 6), (6, 4), (7, 4), (8, 9)] + [(i, i + 1) for i in range(100, 400)]
    got = rows(decisions.chains(spark.createDataFrame(links, "id bigint, superseded_by bigint")), "start", "id", "step")
    of = dict(links)
    want = []
    for start in of:
        now, seen = start, []
        while now is not None and now not in seen:
            seen.append(now)
            now = of.get(now)
        want += [(start, x, k) for k, x in enumerate(seen)]
    assert got == sorted(want, key=str)


def test_stores_merge_when_read(spark, tmp_path):
    store = upserts.Deltas(spark, str(tmp_path / "s"), order=["v"])
    assert store.read() is None
    store.write(spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), (None, 7), (None, 7)], "id string, v int"), 0)
    for _ in range(2):  # a batch that is run again
        store.write(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), 1)
    store.write(spark.createDataFrame([("c", 1)], "id string, v int"), 2)
    want = [("a", 3), ("b", 2), ("c", 1), (None, 7), (None, 7)]
    assert rows(store.read()) == sorted(want, key=str)
    assert rows(store.compact(str(tmp_path / "t")).read()) == sorted(want, key=str)


def test_rankings_are_filled_with_what_no_stage_scored(spark):
    r = spark.createDataFrame([(f"r{i}", "apples and pears" if i == 5 else f"w{i}") for i in range(8)], "id string, text string")
    asked = spark.createDataFrame([("q", "apples"), ("z", "nothing of it")], "query_id string, text string")
    got = rows(retrieve.ranked(retrieve.Corpus(r), asked, "lexical", 3), "query_id", "rank", "id")
    assert got == [("q", 1, "r5"), ("q", 2, "r0"), ("q", 3, "r1"), ("z", 1, "r0"), ("z", 2, "r1"), ("z", 3, "r2")]


def test_sweep_of_presets(spark):
    r = spark.createDataFrame([("a", "login page broken"), ("b", "login page slow"), ("c", "lunch menu"), ("d", "lunch place")], "id string, text string")
    v = embedded(r)[0]
    asked = r.where("id in ('a', 'c')").select(F.col("id").alias("query_id"), "text").join(v.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
    truth = spark.createDataFrame([("a", "b"), ("c", "d")], "query_id string, id string")
    got = retrieve.swept(retrieve.Corpus(r, v), asked, truth, ["lexical", "dense", "hybrid"]).collect()
    assert [x.preset for x in got] == ["lexical", "dense", "hybrid"] and all(x.mrr == 1.0 for x in got)


def test_dates(spark):
    one = spark.range(1).select(when.instant(F.lit("2026-08-14T09:30"), "+07:00").alias("a"), when.instant(F.lit("2026-08-14T09:30:00.5Z"), "+07:00").alias("b"), when.instant(F.lit("next week"), "UTC").alias("c"), when.minute_of(F.lit("25:00")).alias("d"), F.array_join(when.workdays_before(F.lit("2026-08-17").cast("date"), 7), ",").alias("e")).first()
    assert one.b - one.a == 7 * 3600 + 0.5 and one.c is None and one.d is None
    assert one.e == "2026-08-06,2026-08-07,2026-08-10,2026-08-11,2026-08-12,2026-08-13,2026-08-14"


def test_headings_and_replies(spark):
    lines = spark.createDataFrame([("*Done Yesterday:*",), ("Pending รอ requirement",), ("Pending things:",), ("• เมื่อวาน",), ("Blockers / Pending",), ("done with it",), ("",)], "t string")
    assert [r[0] for r in lines.select(dailies.heading_of(F.col("t"))).collect()] == ["done", None, "blockers", "done", "blockers", None, None]
    text = spark.range(1).select(dailies.composed(F.array(F.lit(" a \n\n b ")), F.array().cast("array<string>"), F.lit(None).cast("array<string>")).alias("t")).first().t
    assert text == "Done Yesterday:\na\nb\n\nFocus Today:\n\nBlockers / Pending:"


def test_replies_are_read_within_their_rows(spark):
    text = "hello\n*Done Yesterday:*\n- closed a\n-\nFocus Today\nnone\nBlockers / Pending:\n• Pending key <@U1234567|Nok>\r\n• PO answer"
    said = spark.createDataFrame([(1, text), (2, None), (3, "Pending nothing"), (4, "Done\nFinished ticket #[ID]"), (5, "Focus today\n- next\nxxxx\nD_o_ne:\nb"), (6, "")], "id long, text string")
    found = dailies.parsed_replies(said)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: (r.kind, r.done, r.focus, [tuple(b) for b in r.blockers]) for r in found.collect()}
    assert got[1] == ("answer", ["closed a"], [], [("Pending key <@U1234567|Nok>", "U1234567"), ("PO answer", "PO")])
    assert got[2] == got[3] == got[6] == ("other", [], [], [])
    assert got[4] == ("unfilled", [], [], []) and got[5] == ("answer", ["b"], ["next"], [])


def test_recorded_pages_hold_places_and_no_texts(tmp_path, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 1 << 14)
    said = [{"ts": f"{i}.0", "text": f"ก{i} " * 500, **({"thread_ts": f"{i - i % 4}.0"} if i % 4 else {})} for i in range(1, 4001)]
    folder = tmp_path / "in" / "channel=C1"
    folder.mkdir(parents=True)
    for k in range(2):  # out of order, with blank lines and both ends of lines
        (folder / f"{k}.json").write_bytes(b"\r\n\n".join(json.dumps(m).encode() for m in said[k::2][::-1]))
    size = sum(f.stat().st_size for f in folder.iterdir())
    service = chat._Service({"transport": "colloquy.sources.chat:recorded", "path": str(tmp_path / "in")})
    tracemalloc.start()
    heads = n = 0
    for h in service.heads("C1", "8.0", "3990.0"):
        heads += 1
        at = int(float(h["ts"]))
        replies = [int(float(r["ts"])) for r in service.replies("C1", h)]
        assert h["text"] == said[at - 1]["text"] and replies == [i for i in range(at + 1, at + 4) if i <= 4000] and float(h["latest_reply"]) == replies[-1]
        n += len(replies)
        if heads > 60:
            break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (heads, n) == (61, 183) and peak < size / 3
