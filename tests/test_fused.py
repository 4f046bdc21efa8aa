"""Searches whose blocks send only what can be among the best, against a row for each scored pair."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.operators import fusion, lexical, sparse, vectors
from colloquy.plans import retrieve, work


def test_best_by_bm25_equals_the_head_of_all_scores(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 12)))) for i in range(300)] + [(400, None), (401, ""), (402, "w1 w1 w1")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3"), (3, "nothing here"), (4, "")], "query_id bigint, text string")
    shown = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    want = shown(lexical.top(lexical.scores(lexical.matches(docs, asked)), 7))
    assert shown(lexical.best(docs, asked, 7)) == want and len(want) == 14
    told = {(r.query_id, r.doc_id, r.term) for r in lexical.told(docs, asked, 2).collect()}
    found = lexical.matches(docs, asked).join(lexical.top(lexical.scores(lexical.matches(docs, asked)), 2), ["query_id", "doc_id"], "left_semi")
    assert told == {(r.query_id, r.doc_id, r.term) for r in found.collect()}


def test_counts_of_better_scores(spark):
    rnd = np.random.default_rng(4)
    x = np.round(rnd.standard_normal((60, 4)), 1)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    s = np.round(x[:3] @ x.T, 9)
    scores = spark.createDataFrame([(a, float(s[a, b])) for a in range(3) for b in range(0, 60, 7)], "query_id bigint, score double")
    for itself in (True, False):
        for r in vectors.better(v, q, scores, itself=itself).collect():
            others = s[r.query_id] if itself else np.delete(s[r.query_id], r.query_id)
            assert r.better == (others > r.score).sum()
    rows = spark.createDataFrame([(i, ["a", "b"][: 1 + i % 2], [1.0 + i % 5, 2.0][: 1 + i % 2], 1.0) for i in range(50)], "id bigint, terms array<string>, values array<double>, factor double")
    asked = spark.createDataFrame([(1, ["b", "a"], [0.5, 1.0])], "query_id bigint, terms array<string>, values array<double>")
    all_ = [1.0 + i % 5 + i % 2 for i in range(50)]
    for r in sparse.better(rows, asked, spark.createDataFrame([(1, float(f)) for f in range(-1, 8)], "query_id bigint, score double")).collect():
        assert r.better == sum(x > r.score for x in all_)


def test_fused_heads_equal_fusion_of_all_scores(spark):
    """With few records sent, many ties, and a stage in which very many tie first."""
    rnd = random.Random(5)
    ids, asks = range(120), range(6)
    records = spark.createDataFrame([(i, f"u{i % 2}") for i in ids], "id bigint, user string")
    queries = spark.createDataFrame([(q, f"u{q % 3}") for q in asks], "query_id bigint, user string")
    one = [(q, i, float(rnd.choice([1, 2, 3, rnd.random()]))) for q in asks for i in ids]
    two = [(q, i, rnd.random()) for q in asks for i in ids if q and rnd.random() < 0.4]
    a, b = (spark.createDataFrame(rows, "query_id bigint, id bigint, score double") for rows in (one, two))
    stages = [retrieve._pair_stage(1.0, a), retrieve._pair_stage(0.7, b), retrieve._class_stage(0.2, records, queries, "user")]
    told = {(0, q, i): s for q, i, s in one} | {(1, q, i): s for q, i, s in two} | {(2, q, i): 1.0 for q in asks for i in ids if i % 2 == q % 3}
    want = {}
    for q in asks:
        score = dict.fromkeys(ids, 0.0)
        for k, w in enumerate((1.0, 0.7, 0.2)):
            s = [round(told.get((k, q, i), 0.0), 9) for i in ids]
            for i in ids:
                score[i] += w / (60 + 1 + sum(x > s[i] for x in s))
        want[q] = sorted(ids, key=lambda i: (-round(score[i], 9), i))[:5]
    for m in (2, 16, 1000):
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        found = fusion.reciprocal_best(stages, queries, 5, len(ids), m).withColumn("r", F.row_number().over(order)).orderBy("query_id", "r").collect()
        assert {q: [r.id for r in found if r.query_id == q] for q in asks} == want


def test_neighbours_of_the_graph_are_found_once(spark, tmp_path, monkeypatch):
    """What several steps read is written: no later plan compares the vectors again."""
    x = np.random.default_rng(6).standard_normal((40, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    _, edge, near = work._graph(spark, str(tmp_path))
    assert all("FlatMapGroupsInArrow" not in df._jdf.queryExecution().toString() for df in (edge, near))


def test_related_records_need_no_row_for_each_scored_pair(spark, monkeypatch):
    """All six stages, of which one has half of all records in first place, against the fusion of all scores."""
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"m{i}", " ".join(rnd.choices(words, k=8)) + (f" REV-{i % 5}" if i % 3 == 0 else ""), 1000.0 * i, str(i // 4), f"u{i % 2}", "C1", rnd.choice([[0.6, 0.8], [1.0, 0.0], [rnd.random(), rnd.random()]])) for i in range(90)]
    r = spark.createDataFrame(rows, "id string, text string, ts double, thread_ts string, user string, channel_id string, v array<double>")
    corpus = retrieve.Corpus(r.drop("v"), r.select("id", "v"))
    own = r.where("id in ('m0', 'm41', 'm88')")
    asked = own.select(F.col("id").alias("query_id"), "text", "ts", "thread_ts", "user", F.col("v").alias("q"))
    preset = retrieve.PRESETS["related"]
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    whole = retrieve.fused(retrieve.scored(corpus, asked, preset), asked, preset).withColumn("rank", F.row_number().over(order)).where("rank <= 7")
    want = [(x.query_id, x["rank"], x.id, round(x.score, 9)) for x in whole.orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(retrieve, "scored", None)
    found = retrieve.ranked(corpus, asked, "related", 7)
    assert [(x.query_id, x["rank"], x.id, round(x.score, 9)) for x in found.orderBy("query_id", "rank").collect()] == want
    stage = retrieve._class_stage(0.2, corpus.records, asked, "user")
    assert stage.head(asked.select("query_id"), 44).count() == 0 and stage.head(asked.select("query_id"), 45).count() == 135


def test_blocks_that_send_each_querys_best_are_few(spark, monkeypatch):
    """100,000 records are eight blocks, unless they have very many terms, and two thousand queries more don't make all records be sent again."""
    records = spark.range(100_000).select("id", F.array(F.lit("a"), F.lit("b")).alias("terms"), F.array(F.lit(1.0), F.lit(1.0)).alias("values"), F.lit(1.0).alias("factor"))
    asked = spark.range(5_000).select(F.col("id").alias("query_id"), F.array(F.lit("a")).alias("terms"), F.array(F.lit(1.0)).alias("values"))
    groups = lambda: sparse._dealt(records, asked)[0].count().count()
    assert groups() == 8
    monkeypatch.setattr(sparse, "TERMS", 10_000)
    assert groups() == 20
    v = spark.range(100_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = v.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    dealt, seen = vectors._dealt, []
    monkeypatch.setattr(vectors, "_dealt", lambda *a: seen.append(dealt(*a)) or seen[-1])
    best = {(r.query_id, r.vec_id) for r in vectors.cosine_to(v, q, best=1).collect()}
    assert [across for _, across, _ in seen] == [8] and best == {(0, 0), (1, 99_999), (2, 99_999)}
