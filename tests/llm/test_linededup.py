import random

from colloquy.llm import linededup, winnowing

from .conftest import prose


def docs_with(spark, line_of, n=8, words=30):
    rnd = random.Random(2)
    rows = [(i, "\n".join([prose(rnd, words), line_of(i), prose(rnd, words)])) for i in range(n)]
    rows += [(100 + i, "\n".join(prose(rnd, 12) for _ in range(4))) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), dict(rows)


def slow(docs, documents=3):
    """The texts by id without recurring lines, by plain loops over all distinct texts."""
    import regex

    def tokens(line):
        return regex.findall(winnowing.TOKEN.replace("Is", "") if regex.search(r"[\u0E00-\U0010FFFF]", line) else r"\S+", line)

    having, exactly, slots_of = {}, {}, {}
    for t in {t for t in docs.values() if t}:
        for line in filter(str.strip, t.split("\n")):
            toks = tokens(line)
            exactly.setdefault(tuple(toks), set()).add(t)
            having.setdefault(tuple("<*>" if regex.search("[0-9]", x) else x for x in toks), set()).add(t)
    often, templates = {}, {}
    for g in (g for g in having if len(g) >= linededup.LEAST_TOKENS):
        rest = g[linededup.DEPTH :]
        cut = [rest[len(rest) * s // linededup.SLOTS : len(rest) * (s + 1) // linededup.SLOTS] for s in range(linededup.SLOTS)]
        slots_of[g] = (len(g), g[: linededup.DEPTH]), [(s, x) for s, x in enumerate(cut) if x]
        for slot in slots_of[g][1]:
            often.setdefault((slots_of[g][0], slot), set()).update(having[g])
    for g, (leaf, filled) in slots_of.items():
        constant = [s for s in filled if len(often[leaf, s]) >= documents]
        if filled and 2 * len(constant) >= len(filled):
            templates.setdefault((leaf, tuple(constant)), []).append(g)

    def rule(of):
        """Which lines go, if texts count by what ``of`` makes of them."""
        count = lambda texts: len({of(t) for t in texts})
        recur = {g for g in slots_of if count(having[g]) >= documents}
        for some in templates.values():
            if count(set().union(*(having[g] for g in some))) >= documents:
                recur |= set(some)

        def goes(line):
            toks = tuple(tokens(line))
            least = linededup.LONG_DOCUMENTS if len(toks) >= linededup.LONG else linededup.SHORT_DOCUMENTS if len(toks) < linededup.LEAST_TOKENS else None
            return bool(line.strip()) and ((least and count(exactly[toks]) >= least) or tuple("<*>" if regex.search("[0-9]", x) else x for x in toks) in recur)

        return goes

    first = rule(lambda t: t)
    mostly = {t for t in docs.values() if t and 2 * sum(len(x.encode()) for x in t.split("\n") if first(x)) >= len(t.encode())}
    sets = {t: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for t in mostly for w in [t.lower().split()]}
    group = {t: t for t in sets}
    for a in sets:
        for b in sets:
            if group[a] != group[b] and len(sets[a] & sets[b]) >= linededup.ALIKE * len(sets[a] | sets[b]):
                old = group[b]
                group = {t: group[a] if g == old else g for t, g in group.items()}
    again = rule(lambda t: group.get(t, t))
    return {i: t and "\n".join(x for x in t.split("\n") if not (first(x) and again(x))) for i, t in docs.items()}


def test_against_plain_loops(spark):
    rnd = random.Random(17)
    long, short = [prose(rnd, 25) for _ in range(3)], ["And ornd.", "page end", "x"]
    shapes = [lambda: f"signed in as {prose(rnd, 1)} from the main office", lambda: f"page {rnd.randint(1, 99)} of {rnd.randint(1, 99)}", lambda: f"All rights reserved by {prose(rnd, 2)}", lambda: f"{prose(rnd, 1)} {prose(rnd, 1)} same start and very much the same end here"]
    docs = {}
    for i in range(150):
        lines = [prose(rnd, rnd.randint(1, 30)) for _ in range(rnd.randint(0, 5))]
        lines += [rnd.choice(shapes)() for _ in range(rnd.randint(0, 2))] + rnd.sample(short, rnd.randint(0, 2))
        lines += [rnd.choice(long)] * (rnd.random() < 0.05) + [""] * rnd.randint(0, 1)
        rnd.shuffle(lines)
        docs[i] = "\n".join(lines)
    base = [prose(rnd, 40) for _ in range(6)]
    docs |= {200 + i: "\n".join([*base[:5], f"{base[5]} {i}", "All rights reserved by us all"]) for i in range(4)} | {300: docs[3], 301: docs[4], 302: None, 303: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(7)
    for documents in (3, 5):
        got = {r.doc_id: r.text for r in linededup.without_recurring_lines(df, documents).collect()}
        want = slow(docs, documents)
        assert got == want and sum(a != b for a, b in zip(want.values(), docs.values(), strict=True)) > 20


def kept(df):
    return {r.doc_id: r.text for r in linededup.without_recurring_lines(df).collect()}


def test_recurring_lines_go_and_the_rest_stays(spark):
    df, before = docs_with(spark, lambda i: "All rights reserved by the owners")
    after = kept(df)
    for i, text in before.items():
        lines = text.split("\n")
        assert after[i] == (text if i >= 100 else "\n".join([lines[0], lines[2]]))


def test_variable_fields_are_generalised(spark):
    names = ["ana", "ben", "cleo", "dan", "eva", "finn", "gus", "hal"]
    for line in (lambda i: f"page {i} of 20 printed at 1{i}:30", lambda i: f"signed in as {names[i]} from the main office"):
        df, before = docs_with(spark, line)
        after = kept(df)
        assert all(line(i) not in after[i] for i in range(8))
        assert all(after[i] == before[i] for i in before if i >= 100)


def test_long_passages_that_repeat(spark):
    passage = prose(random.Random(9), 60)
    df, _ = docs_with(spark, lambda i: passage, n=5, words=100)
    assert all(passage not in t for t in kept(df).values())


def test_copies_alone_stay_whole_and_equal_texts_count_once(spark, odd_docs):
    after = [(r.doc_id, r.text) for r in linededup.without_recurring_lines(odd_docs).collect()]
    assert sorted(after, key=str) == sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=str)
    text = "one two three four\nfive six seven eight"
    same = spark.createDataFrame([(i, text) for i in range(9)], "doc_id bigint, text string")
    assert set(kept(same).values()) == {text}


def test_columns_counts_and_empty(spark, odd_docs, no_docs):
    assert linededup.without_recurring_lines(odd_docs).columns == odd_docs.columns
    assert linededup.without_recurring_lines(no_docs).count() == 0
    df, _ = docs_with(spark, lambda i: "All rights reserved by the owners")
    counts = {r.doc_id: (r["__lines"], r["__dropped"]) for r in linededup.dropped(df).collect()}
    assert counts[0] == (3, 1) and counts[100] == (4, 0)


def test_short_documents_that_are_mostly_recurring_lines_lose_them(spark):
    rnd = random.Random(4)
    line = "All rights reserved by the owners of this page and of all that stands on it"
    own = [prose(rnd, 6) for _ in range(6)]
    assert kept(spark.createDataFrame([(i, f"{line}\n{t}") for i, t in enumerate(own)], "doc_id bigint, text string")) == dict(enumerate(own))
    base = [prose(rnd, 40) for _ in range(8)]
    near = ["\n".join([*base[:i], base[i][:-1] + "zz", *base[i + 1 :]]) for i in range(4)]
    short = [f"{base[0]}\n{t}" for t in own]
    after = kept(spark.createDataFrame(list(enumerate(near + short)), "doc_id bigint, text string"))
    lost = ["\n".join(x for x in t.split("\n") if x != base[0]) for t in near]
    assert after == dict(enumerate(lost + own)) and lost[1] != near[1]


def test_near_copies_lose_the_lines_that_stand_elsewhere(spark):
    """Two texts of little but two licence lines, a space apart: both lines stand in many other texts, and go from all."""
    rnd = random.Random(21)
    notes = ["Licensed under the terms of version two of the public licence of the owners", "Redistribution and use in source and binary forms are permitted to all who keep this notice"]
    rows = [(i, f"{prose(rnd, 40)}\n{notes[i % 2]}\n{prose(rnd, 30)}") for i in range(50)]
    rows += [(100, f"{notes[0]}\n{notes[1]}\nsmall own part"), (101, f"{notes[0]}\n{notes[1]}\nsmall own part ")]
    out = {r.doc_id: (r.text, r["__dropped"]) for r in linededup.dropped(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[100] == ("small own part", 2) and out[101] == ("small own part ", 2)
    assert all(n == 1 and not any(x in t for x in notes) for i, (t, n) in out.items() if i < 100)
    alone = [(100, rows[-2][1]), (101, rows[-1][1]), (102, rows[-1][1] + " "), (103, rows[-1][1] + "  ")]
    assert kept(spark.createDataFrame(alone, "doc_id bigint, text string")) == dict(alone)


def test_a_long_line_of_two_texts_recurs_word_for_word(spark):
    passage = prose(random.Random(10), 60)
    df, _ = docs_with(spark, lambda i: passage, n=2, words=100)
    assert all(passage not in t for t in kept(df).values())
    df, before = docs_with(spark, lambda i: f"{passage} {i}", n=2, words=100)
    assert kept(df) == before
    df, before = docs_with(spark, lambda i: "All rights reserved by the owners", n=2)
    assert kept(df) == before


def test_a_template_needs_different_texts_not_lines(spark):
    rnd = random.Random(11)
    shape = lambda x: f"Add two cups {x} to bowl"
    things = ["flour", "sugar", "milk", "salt", "rice"]
    one = "\n".join([prose(rnd, 60), *map(shape, things), prose(rnd, 60)])
    assert kept(spark.createDataFrame([(1, one), (2, prose(rnd, 90))], "doc_id bigint, text string"))[1] == one
    many = spark.createDataFrame([(i, f"{prose(rnd, 30)}\n{shape(x)}\n{prose(rnd, 30)}") for i, x in enumerate(things)], "doc_id bigint, text string")
    for documents, gone in ((3, True), (5, True), (6, False)):
        out = linededup.without_recurring_lines(many, documents).collect()
        assert all(("cups" not in r.text) == gone for r in out)
    twice = [(i, f"{prose(rnd, 30)}\n{shape(things[i % 2])}\n{prose(rnd, 30)}") for i in range(8)]
    for documents, gone in ((5, True), (8, True), (9, False)):
        out = linededup.without_recurring_lines(spark.createDataFrame(twice, "doc_id bigint, text string"), documents).collect()
        assert all(("cups" not in r.text) == gone for r in out)


def test_short_lines_and_scripts_without_spaces(spark):
    for n, gone in ((9, False), (10, True)):
        df, before = docs_with(spark, lambda i: "And ornd.", n=n)
        assert all(("And ornd." not in t) == gone for i, t in kept(df).items() if i < 100)
    df, before = docs_with(spark, lambda i: f"page {i}\n\n{i}", n=12)
    assert kept(df) == before
    for line in ("版權所有未經許可不得轉載" * 8, "สงวนลิขสิทธิ์ตามกฎหมาย" * 4, "すべての権利を保有します"):
        df, _ = docs_with(spark, lambda i, line=line: line, n=3)
        assert all(line not in t for t in kept(df).values())
