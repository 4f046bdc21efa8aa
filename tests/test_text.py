from colloquy.functions import cues, when
from colloquy.functions import text as T
from colloquy.operators import signals, state
from pyspark.sql import functions as F


def col(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_tokens_keep_the_whole_and_its_parts(spark):
    got = col(spark, ["REV-1421 getUserProfile", "a_b v2.0", "ยังรอ", "ก", "", "HTMLParser"], T.tokens)
    assert got[0] == ["rev-1421", "rev", "1421", "rev", "1421", "getuserprofile", "get", "user", "profile"]
    assert got[1] == ["a_b", "a", "b", "a", "b", "v2.0", "v2", "0", "v", "2", "0"]
    assert got[2] == ["ยั", "ัง", "งร", "รอ", "ยัง", "ังร", "งรอ"]
    assert got[3:] == [["ก"], [], ["htmlparser", "html", "parser"]]


def test_terms_are_the_tokens(spark):
    odd = ["REV-1421 getUserProfile", "a_b v2.0 x- -y a--b A1b2 ABCd ABcd abC", "ยังรอapi ก", "", None, "HTMLParser K9 3.14 1a Z", "Kelvin K İx éa-b日本a", "a.b/c_d-E end."]
    assert [x and sorted(x) for x in col(spark, odd, T.terms)] == [x and sorted(x) for x in col(spark, odd, T.tokens)]


def test_normalize(spark):
    raw = "hi <@U12|Nok>, see <https://x.y/z|the page> or <mailto:a@b.c> in <#C1|dev> <#C2> <!here> :tada: &amp; <@U9>\r\n\r\n  next  line "
    assert col(spark, [raw], T.normalize) == ["hi @Nok, see the page or a@b.c in #dev & @U9\nnext line"]
    assert col(spark, ["<@U1> <@U2|b> <@U1>", "none"], T.mentions) == [["U1", "U2"], []]


def test_usefulness(spark):
    said = ["ok thanks!", "555", "!!!", "", None, "😀 👍", "merged", "ok, pr up", "the page is broken", "@Claude has joined the channel", "ได้ครับ"]
    assert col(spark, said, T.is_useful) == [False, False, False, False, False, False, True, True, True, False, False]


def test_asserted_lines(spark):
    text = "> quoted\nmine `code` here\n```\nfixed\n```\n~done~ kept\n&gt; also quoted\n```open fence\nblocked"
    lines = ["mine here", "kept"]
    assert col(spark, [text, "```x```", None], T.asserted_lines) == [lines, [], None]
    assert col(spark, [text], T.analysis) == [" ".join(lines)]


def test_cues_are_whole_words(spark):
    first = lambda kind: lambda c: T.first_cue(c, cues.RELATIONS[kind][2], cues.RELATIONS[kind][1])
    assert col(spark, ["It is fixed now", "prefixed", "unresolved", "abandoned", "FIXED!"], first("resolves")) == ["fixed", None, None, None, "fixed"]
    assert col(spark, ["android", "No, that is fine", "x" * 60 + " no"], first("answers")) == [None, "no", None]
    assert col(spark, ["ยังรอ api อยู่", "รอบนี้"], first("blocked_by")) == ["ยังรอ", None]
    assert col(spark, ["eta? on this"], first("follows_up")) == ["eta?"]


def test_anchors(spark):
    said = ["See REV-1421 in v2.1.0 of src/app/main.py at https://x.io/a", 'the "Sales Cloud" page', "Wanted to share. Ask about Profile today", "I've fixed it, and we're done", "Monday Update"]
    got = [set(x) for x in col(spark, said, signals.anchors)]
    assert {"rev-1421", "v2.1.0", "src/app/main.py", "https://x.io/a"} <= got[0]
    assert "sales cloud" in got[1]
    assert "profile" in got[2] and "wanted" not in got[2]
    assert not any("fixed" in a for a in got[3])
    assert got[4] == set()


def test_ticket_keys_and_prefixes(spark):
    assert col(spark, ["rev-1 REV-1421 and MOB-7, REV-1421", "UTF-8 X-1 AB-1234567"], T.ticket_keys) == [["REV-1421", "MOB-7"], ["UTF-8"]]


def test_waiting_lines(spark):
    said = ["- Pending review by <@U1234567>", "P'Mos - Done all API pending + support", "all closed but pending the other api", "*Pending task*\nthe other team's answer\n*Others*\nnothing of note here", "any progress on pending task?", "pending", "```\nblocked by quoted text\n```", "`/x blocked` try it out please"]
    rows = spark.createDataFrame([(str(i), "U1", float(i), t, "slack") for i, t in enumerate(said)], "id string, user string, ts double, text string, source string")
    got = {(r.id, r.line, r.cue, tuple(r.waiting_on)) for r in state.waiting_lines(rows).collect()}
    assert got == {("0", "Pending review by <@U1234567>", "pending", ("U1234567",)), ("2", "all closed but pending the other api", "pending", ()), ("3", "the other team's answer", "heading", ())}


def test_standup_form(spark):
    form = "What did you accomplish yesterday?\n- things\nAre there any blockers?\n"
    said = [form + "waiting for the clearing user on dev", form + "-", form + "None.", "Blockers:\nthe api returns nothing at all", "any blockers here? no idea"]
    rows = spark.createDataFrame([(str(i), f"U{i}", float(i), t) for i, t in enumerate(said)], "id string, user string, ts double, text string")
    slots = state.form_slots(rows)
    assert {r.id: r.answers for r in state.declared(slots).collect()} == {"0": ["waiting for the clearing user on dev"], "3": ["the api returns nothing at all"]}
    assert {r.user for r in state.cleared(slots).collect()} == {"U1", "U2"}
    assert {r.id for r in state.is_form(slots).collect()} == {"0", "1", "2"}


def test_times(spark):
    assert col(spark, ["1754000010.000100", "bad", None, "nan"], lambda c: when.shown(c, "Asia/Bangkok")) == ["2025-08-01 05:13", "unknown", "unknown", "unknown"]
    near = spark.sql("select 0d a, 5400d b, 172801d c, cast(null as double) d").select(when.nearness(F.col("a"), F.col("b")), when.nearness(F.col("a"), F.col("c")), when.nearness(F.col("a"), F.col("d"))).first()
    assert abs(near[0] - 0.36787944) < 1e-6 and near[1] == near[2] == 0.0


def test_business_days(spark):
    from datetime import date, timedelta

    days = [(date(2026, 8, 1) + timedelta(a), date(2026, 8, 1) + timedelta(b)) for a in range(14) for b in range(-2, 40)]
    got = spark.createDataFrame(days, "a date, b date").select("a", "b", when.business_days(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == sum((r.a + timedelta(k)).weekday() < 5 for k in range(1, (r.b - r.a).days + 1)) for r in got)


def test_blockers_compare(spark):
    assert col(spark, ["Pending รอ requirement <@U12>", "รอ requirement", "pending: the API!", "pendingx"], T.normal_blocker) == ["รอ requirement", "รอ requirement", "the api", "pendingx"]


def test_only_records_with_a_cue_or_heading_are_taken_apart(spark, monkeypatch):
    taken = []
    whole = F.posexplode
    monkeypatch.setattr(state.F, "posexplode", lambda c: taken.append(c) or whole(c))
    rows = spark.createDataFrame([("a", "u", 1.0, "plain\n" * 50), ("b", "u", 2.0, "• the api is pending on their side"), ("c", "u", 3.0, "*On hold*\n• rollout of the new gate"), ("d", "u", 4.0, "Blockers?\nnone at all today")], "id string, user string, ts double, text string")
    assert sorted((r.id, r.line) for r in state.waiting_lines(rows).collect()) == [("b", "the api is pending on their side"), ("c", "rollout of the new gate")]
    assert [(r.id, r.answer) for r in state.form_slots(rows).orderBy("pos").collect()] == [("d", None), ("d", "none at all today")]
    assert len(taken) == 2
    for made in (state.waiting_lines(rows), state.form_slots(rows)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "exists(" in plan[plan.rindex("Generate posexplode") :]  # the filter lies below
