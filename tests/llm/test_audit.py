import random
import re
from itertools import permutations

from colloquy.llm import audit
from pyspark.sql import functions as F

from .conftest import prose


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def slow(docs, labels):
    """Each order applied to the documents one filter after the other."""
    said = {}
    for i, quality, toxic in labels:
        if i is not None:
            g, t = said.get(i, (0, 0))
            said[i] = max(g, int(quality == 1)), max(t, int(toxic == 1))
    least = {}
    for i, text, _ in docs:
        least[text or ""] = min(least.get(text or "", float("inf")), float("inf") if i is None else i)
    rows = [(lang or "", fails(text or "") + ("E" if (float("inf") if i is None else i) > least[text or ""] else ""), *said.get(i, (0, 0))) for i, text, lang in docs]
    out, removed_by = {}, {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order):
                gone, before = [r for r in left if c in r[1]], len([r for r in mine if c in r[1]])
                left = [r for r in left if c not in r[1]]
                removed_by[part, c] = removed_by.get((part, c), 0) + len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), before - len(gone), len([r for r in mine if r[1] == c]), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_filters_in_every_order(spark, odd_docs):
    rnd = random.Random(12)
    docs = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()]
    for i in range(120):
        words = prose(rnd, rnd.choice([50, 250, 400])) if rnd.random() < 0.6 else " ".join(["la"] * rnd.choice([10, 300]))
        words = words.upper() if rnd.random() < 0.3 else words
        docs.append((1000 + i, words + rnd.choice(["", " |", " 100%", "\x0b\x1c"]), rnd.choice(["en", "de", "", None])))
    docs += [(2000 + i, docs[60 + i % 5][1], "en") for i in range(20)] + [(None, docs[60][1], "de"), (None, "alone", "de"), (None, "alone", "fr")]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i, *_ in docs if rnd.random() < 0.5] + [(1001, 1, None), (1001, 0, 1), (None, 1, 1), (999_999, 1, 1)]
    made = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("good", F.lit("clash"))
    found = audit.audited(made, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit(1)))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == slow(docs, labels) and len(got) == 600 * len({lang or "" for *_, lang in docs})


def test_empty_tables_and_other_filters(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audited(no_docs, labels).count() == 0
    masks = spark.createDataFrame([("p", m, 1) for m in (0, 1, 2, 3, 3)], "part string, mask int, seen int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.seen_lost, r.shapley) for r in audit.interactions(masks, "xy", ["seen"]).collect()}
    assert got == {("xy", 1): (2, 3, 0, 1, 3, 4), ("xy", 2): (1, 1, 2, 1, 1, 4), ("yx", 1): (2, 3, 0, 1, 3, 4), ("yx", 2): (1, 1, 2, 1, 1, 4)}
