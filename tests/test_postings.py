import random

import pytest
from colloquy.operators import lexical, postings
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("n", "r", "st", "l", "d", "m", "v", "z")]


def found(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())


def plain(docs, queries, k):
    return found(lexical.top(lexical.scores(lexical.matches(docs, queries)), k))


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choices(WORDS[: 8 + i % 40], k=rnd.randint(0, 30)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "kan " * 50), (None, "kan lor")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_a_search_of_an_index_is_one_of_the_texts(spark, docs, tmp_path):
    queries = spark.createDataFrame([(1, "kan lor"), (2, "mist mist raz"), (3, "nothing here"), (4, ""), (5, " ".join(WORDS))], "query_id int, text string")
    index = postings.Index(spark, str(tmp_path / "a"), range_docs=16)
    assert index.search(queries, 5).count() == 0
    index.append(docs)
    now = docs.where("doc_id is not null")
    assert found(index.search(queries, 5, first=1)) == plain(now, queries, 5)
    # documents anew, some of them twice, some unknown before, one that loses its text
    batch = spark.createDataFrame([(i, f"raz kan {i}") for i in range(0, 300, 50)] + [(7, None), (900, "mist lor lor")], "doc_id bigint, text string")
    index.append(batch)
    index.append(spark.createDataFrame([(50, "lor lor lor mist"), (900, "pel")], "doc_id bigint, text string"))
    now = now.join(batch, "doc_id", "left_anti").unionByName(batch.where("doc_id not in (50, 900)"))
    now = now.unionByName(spark.createDataFrame([(50, "lor lor lor mist"), (900, "pel")], "doc_id bigint, text string"))
    want = plain(now, queries, 5)
    assert found(index.search(queries, 5, first=1)) == want
    assert sum(r.n for r in index.live().groupBy("segment").agg(F.count("*").alias("n")).collect()) == now.count()
    merged = index.merge(str(tmp_path / "b"))
    assert merged.segments() == [1] and found(merged.search(queries, 5)) == want


def test_a_segment_without_its_last_table_does_not_count(spark, docs, tmp_path):
    index = postings.Index(spark, str(tmp_path / "c"), range_docs=64)
    index.append(docs)
    queries = spark.createDataFrame([(1, "kan lor")], "query_id int, text string")
    want = found(index.search(queries, 3))
    docs.limit(0).selectExpr("doc_id", "0 as range", "0 as dl").write.parquet(str(tmp_path / "c/docs/segment=2"))  # a writer that was lost
    assert index.segments() == [1] and found(index.search(queries, 3)) == want


def test_terms_are_counted_within_their_document(spark):
    said = [(1, "b a-b a a"), (2, ""), (3, None), (4, "a c"), (4, "c d"), (None, "a")]
    docs = spark.createDataFrame(said, "doc_id long, text string")
    assert sorted(map(tuple, lexical.term_totals(docs).collect())) == [("a", 3, 6), ("a-b", 1, 1), ("b", 1, 3), ("c", 1, 2), ("d", 1, 1)]
    once = lexical.term_totals(docs.where("doc_id < 4"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # only sums by term


def test_of_rows_with_one_id_an_index_has_the_greatest_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (1, "zeta zeta alpha"), (2, "beta"), (3, None), (None, "beta")], "doc_id long, text string")
    index = postings.Index(spark, str(tmp_path / "index"))
    index.append(docs)
    got = {(r.doc_id, r.term): (r.tf, r.dl) for r in index._whole("postings").collect()}
    assert got == {(1, "zeta"): (2, 3), (1, "alpha"): (1, 3), (2, "beta"): (1, 1)}
    assert tuple(index._whole("totals").select("docs", "tokens").first()) == (3, 4)


def test_a_search_shuffles_no_row_for_each_query_of_a_posting(spark, tmp_path):
    """Forty queries of the same words shuffle hardly more rows than one, and find the same."""
    docs = spark.createDataFrame([(i, "kan lor " * (1 + i % 7) + f"x{i % 50}") for i in range(1500)], "doc_id bigint, text string")
    index = postings.Index(spark, str(tmp_path / "d"), range_docs=100)
    index.append(docs)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    def rows(n):
        before = shuffled()
        got = found(index.search(spark.createDataFrame([(q, "kan lor x7") for q in range(n)], "query_id int, text string"), 3))
        return got, sum(v for k, v in shuffled().items() if k not in before)

    (one, few), (many, more) = rows(1), rows(40)
    assert many == [(q, *r[1:]) for q in range(40) for r in one] and len(one) == 3
    assert more < few + 20_000
