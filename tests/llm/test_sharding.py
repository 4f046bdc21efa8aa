import random
import zlib

import pytest
from colloquy.llm import sharding


def check(rows, docs, n):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs if d.doc_id is not None)
    assert len(rows) == len(docs)
    sizes = [0] * n
    slots = [[] for _ in range(n)]
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    return sizes


def test_equal_bytes(spark):
    rows = [(i, "x" * (i * 7919 % 500), f"src{i % 3}" if i % 3 else "hot", "en") for i in range(3000)] + [(5000 + i, "copy of one text " * 20, "hot", "en") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    for n in (8, 5):
        sizes = check(sharding.shards(docs, n_shards=n).collect(), docs.collect(), n)
        assert max(sizes) - min(sizes) <= 4 * 501
    target = sum(len(r[1]) + 1 for r in rows) // 4
    assert len({r.shard for r in sharding.shards(docs, target_bytes=target).collect()}) == 4


def test_split_is_the_weighted_median(spark):
    """One dimension: two shards split where a sorted running sum passes half."""
    docs = spark.createDataFrame([(i, "y" * (i * 37 % 90)) for i in range(500)], "doc_id bigint, text string").select("doc_id", "text")
    rows = sharding.shards(docs, n_shards=2).collect()
    sizes = check(rows, docs.collect(), 2)
    assert abs(sizes[0] - sizes[1]) <= 2 * 91


def test_odd_rows(odd_docs, no_docs):
    check(sharding.shards(odd_docs, n_shards=8).collect(), odd_docs.collect(), 8)
    assert sharding.shards(no_docs, n_shards=8).count() == 0


def slow_shards(rows, n):
    """The tree by sorting: a node's rows in order of its widest dimension and all that splits ties, cut at the byte that is due."""
    dims = ["size", "doc", "lang", "source"]
    spread = {d: max(1, max(r[d][0] for r in rows) - min(r[d][0] for r in rows)) for d in dims}
    out = {}

    def split(some, first, shards):
        if shards == 1 or not some:
            out.update((r["row"], first) for r in some)
            return
        wide = {d: (max(r[d][0] for r in some) - min(r[d][0] for r in some)) / spread[d] for d in dims}
        along = max(dims, key=lambda d: (wide[d], d))
        some = sorted(some, key=lambda r: (*r[along], r["doc"], r["crc"], r["row"]))
        target, below, k = sum(r["size"][0] for r in some) * (shards // 2) / shards, 0, 0
        while below + some[k]["size"][0] < target:
            below += some[k]["size"][0]
            k += 1
        k += below + some[k]["size"][0] / 2 <= target
        split(some[:k], first, shards // 2)
        split(some[k:], first + shards // 2, shards - shards // 2)

    split(rows, 0, n)
    return out


def test_against_a_tree_by_sorting(spark, odd_docs):
    rnd = random.Random(3)
    names = ["common_crawl", "common_voice", "common", "hot", "", None]
    made = [(i, "x" * rnd.randint(0, 300), rnd.choice(names), rnd.choice(["en", "de", "zh-Hant", "zh-Hans"])) for i in range(900)]
    made += [(7, "same", "hot", "en")] * 200 + [(None, f"t{i}", "hot", "en") for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, source string, lang string").repartition(6)
    for frame in (docs, odd_docs):
        base = sharding.measured(frame).collect()
        rows = [{"row": r.row, "size": (r.size,), "doc": (r.d_doc,), "lang": (r.d_lang, r.h_lang), "source": (r.d_source, r.h_source), "crc": r.text_crc32} for r in base]
        for n in (8, 3):
            want = slow_shards(rows, n)
            got = sorted(((r.doc_id, r.text_crc32, r.shard) for r in sharding.shards(frame, n_shards=n).collect()), key=str)
            assert got == sorted(((r.doc_id, r.text_crc32, want[r.row]) for r in base), key=str)


def test_rows_that_agree_in_all_but_the_text_are_split(spark):
    docs = spark.createDataFrame([(None, f"text{i:03}", "hot", "en") for i in range(400)], "doc_id bigint, text string, source string, lang string")
    assert check(sharding.shards(docs, n_shards=8).collect(), docs.collect(), 8) == [400] * 8
    docs = spark.createDataFrame([(1, "a copy", "hot", "en")] * 400, "doc_id bigint, text string, source string, lang string")
    assert check(sharding.shards(docs, n_shards=8).collect(), docs.collect(), 8) == [350] * 8


@pytest.mark.parametrize("rows", [[(1, "a")], [(7, "same")] * 9, [(None, None)] * 3])
def test_few_and_equal_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check(sharding.shards(docs, n_shards=8).collect(), docs.collect(), 8)


def test_many_shards_and_searches_by_bins(spark, monkeypatch):
    """300 shards by nine levels, with bins down to a few rows: no shard is further from even than the largest rows."""
    rnd = random.Random(6)
    rows = [(i, "z" * rnd.randint(0, 40), f"source {i % 7}" if i % 3 else "hot", None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    monkeypatch.setattr(sharding, "SORTED", 40)
    monkeypatch.setattr(sharding, "FEW", 100)  # later levels shuffle their nodes
    found = sharding.shards(docs, n_shards=300)
    sizes = check(found.collect(), docs.collect(), 300)
    assert max(sizes) - min(sizes) <= 4 * 41
