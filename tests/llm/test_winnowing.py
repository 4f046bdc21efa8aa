import random

import xxhash
from colloquy.llm import winnowing

from .conftest import prose

K, W = winnowing.K, winnowing.W


def grams(text, k=K):
    """Hashes of k words in a row: by Spark's chained XXH64 over longs, of the longest part that is a power of two and the rest."""
    import regex

    tokens = regex.findall(r"[^\x20\x09-\x0d\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]", text.lower())
    h = [xxhash.xxh64_intdigest(t, 42) for t in tokens]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed)
        return seed

    def run(values):
        if len(values) == 1:
            return values[0]
        first = 1 << (len(values) - 1).bit_length() - 1
        return chain([run(values[:first]), run(values[first:])])

    return [run(h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else ([chain(h)] if h else [])


def brute(text, k=K, w=W):
    g = grams(text or "", k)
    keys = [h & ((1 << 33) - 1) for h in g]
    chosen = []
    for s in range(max(1, len(g) - w + 1) if g else 0):
        window = range(s, min(s + w, len(g)))
        least = min(keys[i] for i in window)
        at = max(i for i in window if keys[i] == least)
        if at not in chosen:
            chosen.append(at)
    return [(i, g[i] - (1 << 64) if g[i] >> 63 else g[i]) for i in chosen]


def test_against_brute_force(spark, odd_docs):
    from pyspark.sql import functions as F

    rows = odd_docs.where("doc_id != 303 or doc_id is null").select("text", winnowing.fingerprint(F.col("text")).alias("f")).collect()
    for r in rows:
        assert [(x.pos, x.hash) for x in r.f] == brute(r.text), r.text
    for k, w in ((1, 1), (7, 5), (3, 12)):
        for r in odd_docs.where("doc_id < 40").select("text", winnowing.fingerprint(F.col("text"), k, w).alias("f")).collect():
            assert [(x.pos, x.hash) for x in r.f] == brute(r.text, k, w), (k, w, r.text)


def test_a_shared_run_is_always_met(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(8)
    shared = prose(rnd, W + K - 1)
    rows = [(prose(rnd, rnd.randint(0, 50)) + " " + shared + " " + prose(rnd, rnd.randint(0, 50)),) for _ in range(30)]
    found = [{x.hash for x in r.f} for r in spark.createDataFrame(rows, "t string").select(winnowing.fingerprint(F.col("t")).alias("f")).collect()]
    assert all(found[0] & f for f in found)


def test_positions_say_where(spark, odd_docs, no_docs):
    rnd = random.Random(9)
    shared = prose(rnd, W + K - 1)
    docs = spark.createDataFrame([(i, f"{prose(rnd, i)} {shared} {prose(rnd, 9)}", "a", 3) for i in (1, 20, 33)], "doc_id bigint, text string, pos string, hash int")
    at = {}
    for r in winnowing.fingerprints(docs).collect():
        at.setdefault(r.hash, {})[r.doc_id] = r.pos
    found = [x for x in at.values() if len(x) == 3]
    assert found and all({i: p - i for i, p in x.items()}.keys() == {1, 20, 33} and len({p - i for i, p in x.items()}) == 1 for x in found)
    assert winnowing.fingerprints(no_docs).count() == 0
    assert {r.doc_id for r in odd_docs.collect()} - {r.doc_id for r in winnowing.fingerprints(odd_docs).collect()} == {300, 301, 302}


def test_edited_texts_and_neighbours(spark, odd_docs, no_docs):
    import hashlib

    rows = odd_docs.collect()
    distinct = sorted({(r.doc_id if r.doc_id is not None else winnowing.NO_ID, r.text or "") for r in rows})
    follow = {a: b[1] for a, b in zip(distinct, distinct[1:] + distinct[:1], strict=True)}
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in winnowing.compared(odd_docs).collect()), key=str)
    want = []
    for r in rows:
        t = r.text or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[(r.doc_id if r.doc_id is not None else winnowing.NO_ID, t)][:half]
        want.append((r.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert winnowing.compared(no_docs).count() == 0
    out = {r.doc_id: r for r in winnowing.compared(odd_docs).collect()}
    assert out[100].fingerprint == out[110].fingerprint and out[100].near_next == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out.values())
    alone = spark.createDataFrame([(4, "only one text here")], "doc_id bigint, text string")
    assert winnowing.compared(alone).first().near_next == 1.0
