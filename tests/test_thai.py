import random

from colloquy.functions import thai

WORDS = ["รอ", "รอบ", "นี้", "ยัง", "กรอก", "ไม่", "มา", "ได้", "ทำ", "อยู่", "หรอ", "งาน", "งานนี้", "เสร็จ", "แล้ว", "ต้อง", "ตา", "กลม", "ตาก", "ลม"]


def slow(run, words):
    """All ways to cut a run, judged one by one."""
    edge = [i in (0, len(run)) or not (thai.FOLLOWS.match(run[i]) or thai.LEADS.match(run[i - 1])) for i in range(len(run) + 1)]
    ways = []

    def go(i, parts):
        if i == len(run):
            ways.append(parts)
            return
        for j in range(i + 1, len(run) + 1):
            if edge[j]:
                known = run[i:j] in words
                if known or not (parts and not parts[-1][1]):
                    go(j, [*parts, (run[i:j], known)])
                if not known and parts and not parts[-1][1]:
                    continue

    go(0, [])
    cost = lambda w: (sum(len(p) for p, known in w if not known), len(w))
    return min(cost(w) for w in ways)


def test_shortest_paths_against_all_ways():
    rnd = random.Random(4)
    for _ in range(400):
        words = set(rnd.sample(WORDS, rnd.randint(1, len(WORDS))))
        run = "".join(rnd.choice([*WORDS, "ก", "ข", "เ", "า"]) for _ in range(rnd.randint(1, 4)))[:11]
        parts = thai.Lattice(words)._run(run)
        assert "".join(parts) == run
        known = [p in words for p in parts]
        assert (sum(len(p) for p, k in zip(parts, known, strict=True) if not k), len(parts)) <= slow(run, words), (run, parts)


def test_cues_are_runs_of_whole_words():
    lattice = thai.Lattice(WORDS)
    assert lattice.find("ยังรอ api อยู่", ["ยังรอ", "รอ", "api"]) == [("ยังรอ", 0), ("รอ", 3), ("api", 6)]
    assert lattice.find("รอบนี้", ["รอ", "รอบ"]) == [("รอบ", 0)] and lattice.find("กรอกแล้ว หรอ", ["รอ"]) == []
    assert lattice.find("ทำไม่ได้ x", ["ไม่ได้", ""]) == [("ไม่ได้", 2)] and lattice.find("", ["รอ"]) == []
    assert lattice._run("งานนี้เสร็จ") == ("งานนี้", "เสร็จ")


def test_in_batches(spark):
    rows = spark.createDataFrame([(1, "ยังรอ Api อยู่", "x"), (2, None, "y"), (3, "", "z")], "id bigint, text string, cues string")
    found = {r.id: [(c.cue, c["at"]) for c in r.cues] for r in thai.with_cues(rows, ["รอ", "api"], WORDS).collect()}
    assert found == {1: [("รอ", 3), ("api", 6)], 2: [], 3: []}
    assert {r.id: r.words for r in thai.with_words(rows, WORDS).collect()} == {1: ["ยัง", "รอ", "อยู่"], 2: [], 3: []}
