import random
import re

import pytest
from colloquy.llm import linerules
from pyspark.sql import functions as F

from .conftest import prose

SPACE = r"[\x20\x09-\x0d]"


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def sentences(rnd, n):
    return "\n".join(f"{prose(rnd, 12).capitalize()}. {prose(rnd, 8).capitalize()}!" for _ in range(n))


def test_measures_by_hand_and_by_loops(spark, odd_docs, no_docs):
    rnd = random.Random(5)
    base = prose(rnd, 30)
    texts = [r.text or "" for r in odd_docs.collect() if r.doc_id != 303]
    texts += [f"{base} {prose(rnd, 9)} {base}", " ".join(["a"] * 9), " ".join(["a"] * 8), "x\n\nx\n x\nx", "|#*\x0b%\x1c& <>   ", "😀 é\x0c\x0dz"]
    texts += [" ".join(rnd.choice("ab") for _ in range(n)) for n in range(0, 60, 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in linerules.judged(docs).collect():
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert got == measures(texts[r.doc_id]), texts[r.doc_id]
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0]) and not (r.base_failed and r.kept)
    assert linerules.judged(no_docs).count() == 0


def test_rows_and_columns_stay(spark, odd_docs):
    made = odd_docs.withColumn("kept", F.lit("clash")).withColumn("lines", F.lit(3)).withColumn("line", F.lit("x"))
    found = linerules.judged(made)
    assert found.count() == odd_docs.count() and set(odd_docs.columns) <= set(found.columns) and dict(found.dtypes)["kept"] == "boolean"
    rows = {r.doc_id: r for r in found.collect()}
    assert not rows[300].kept and not rows[301].kept and rows[300].clean_text == "" and rows[302].n_words == 0


@pytest.mark.parametrize(("line", "why"), [
    ("Home | About | Contact | Press", "navigation"),
    ("News > World > Europe > Weather", "navigation"),
    ("This site uses cookies to make your visit better.", "boilerplate"),
    ("Please enable JavaScript to go on.", "boilerplate"),
    ("that*** this%%% with### other&&& words$$$", "punctuation"),
    ("WIN!! NOW!! CALL!! US!! TODAY!!", "punctuation"),
    ("seven eight nine ten eleven twelve one two three four five six", "punctuation"),
    ("A sentence of words that ends as it should. Another one, cut before its", None),
    ("A short heading", None),
    ("The ratio a | b was measured in all of the many runs that we have made so far, and it stayed.", None),
    ("It cost $5, or 10% more than before, at most.", None),
    ("版權所有，未經許可不得轉載。", None),
])
def test_lines(spark, line, why):
    assert spark.range(1).select(linerules.fails(F.lit(line)).alias("w")).first().w == why


def test_documents_that_lose_too_much(spark):
    rnd = random.Random(6)
    menu = "Home | About us | Contact | Press | Jobs | Help"
    good, little = sentences(rnd, 10), sentences(rnd, 10).split("\n")
    much = "\n".join([*little[:3], *[f"{menu} | {prose(rnd, 3)} | {prose(rnd, 3)}" for _ in range(6)]])
    docs = spark.createDataFrame([(1, good), (2, "\n".join([menu, *little])), (3, much), (4, menu)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in linerules.judged(docs).collect()}
    assert {i: r.kept for i, r in out.items()} == {1: True, 2: True, 3: False, 4: False}
    assert out[1].clean_text == good and out[2].clean_text == "\n".join(little) and out[2].lost.navigation == 1 and out[3].lost.navigation == 6


def test_labelled_documents(spark):
    """The driver's labels: good documents that pass the base stay, nearly all others go."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = linerules.judged(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in found.collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * (n.get((0, False), 0) + 1)
