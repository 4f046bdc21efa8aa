import random

import corpus_pipeline
import numpy as np
import xxhash
from colloquy.llm import components, simhash

from .conftest import prose


def brute(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    label = {k: k for k in range(len(prints))}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(k) for k in range(len(prints))]


def test_against_brute_force(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    prints = [brute(t) for _, t in rows]
    roots = brute_components(prints, 2)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(((i, p, least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=str)
    got = sorted(((r.key, r.words[0] % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str)
    assert got == want


def test_links_within_the_radius_are_all_found_and_hot_tiles_are_cut(spark):
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    near = {centre} | {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    values = sorted(near)
    df = spark.createDataFrame([(k, [v - (1 << 64) if v >> 63 else v]) for k, v in enumerate(values)], "node bigint, words array<bigint>")
    for rows in (2048, 16):
        found = components.components(simhash.links(df, 1, 2, tile_rows=rows)).collect()
        roots = {r.node: r.root for r in found}
        want = brute_components(values, 2)
        assert [roots.get(k, k) for k in range(len(values))] == want


def test_fingerprint_bits_are_exact_in_parts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 70_001, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    assert simhash.fingerprint(h) == [want]


def test_near_copies_by_five_words(spark):
    rnd = random.Random(3)
    texts = []
    for g in range(12):
        base = prose(rnd, 400).split()
        for c in range(3):
            mine = list(base)
            for _ in range(4 * (c > 0)):
                mine[rnd.randrange(400)] = f"edit{rnd.random()}"
            texts.append((len(texts), " ".join(mine)))
    clean = [(1000 + i, prose(rnd, 300)) for i in range(60)]
    docs = spark.createDataFrame(texts + clean, "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, shingle=5, words=8, radius=94, deal="minima", bands=8).collect()}
    assert {i for i, _ in clean} <= kept
    assert kept - {i for i, _ in clean} == {3 * g for g in range(12)}


def test_near_copies_with_repeated_lines(spark):
    rnd = random.Random(6)
    line = prose(rnd, 10)
    texts = [prose(rnd, 300)]
    texts += [texts[0] + f"\n{line}" * n for n in (5, 10, 40)]  # Jaccard 0.93 to the first, 1 to each other
    texts += [prose(rnd, 60) + f"\n{line}" * 400 for _ in range(6)]  # little in common but the line
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in simhash.one_of_each(docs, **corpus_pipeline.NEAR).collect()}
    assert kept == {0, *range(4, 10)}


def test_candidates_are_confirmed_in_chunks(spark):
    rnd = random.Random(8)
    base = prose(rnd, 200).split()
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in range(0, 60, 2)]
    far = [" ".join([*base[:150], *prose(rnd, 50).split()]) for _ in range(5)]
    texts = near + far
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    named = simhash.fingerprints(docs, 5, 8, once=True).selectExpr("0L as root", "key as node", "words", "th")
    want = brute_alike(texts, 5, 0.8)
    for rows in (256, 4):
        found = components.components(simhash.confirmed(named, docs, 5, 8, 512, 0.8, group_rows=rows)).collect()
        roots = {r.node: r.root for r in found}
        assert [roots.get(k, k) for k in range(len(texts))] == want


def test_large_tiles_and_groups_are_compared_with_one_and_then_the_rest_with_all(spark):
    rnd = random.Random(12)
    base = prose(rnd, 120).split()
    near = [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in range(60)]
    chain, now = [], list(base)
    for k in range(30):  # each is near the one before, and less and less near the first
        now = [*now[:k * 4], *prose(rnd, 4).split(), *now[k * 4 + 4 :]]
        chain.append(" ".join(now))
    texts = near + chain + [prose(rnd, 100) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_alike(texts, 5, 0.8)
    for sizes in ({}, {"tile_rows": 5, "group_rows": 3}):
        got = {r.key: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR, **sizes).collect()}
        assert [got[k] for k in range(len(texts))] == want
    prints = {r.key: r.words[0] & ((1 << 64) - 1) for r in simhash.fingerprints(docs, 3).collect()}
    label = list(range(len(texts)))
    for i in label:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    for rows in (2048, 4):
        got = {r.key: r.component_id for r in simhash.near_duplicates(docs, radius=8, tile_rows=rows, deal="minima", bands=1).collect()}
        assert all(got[k] >= label[k] for k in got)
        if rows == 2048:
            first = got
    assert got == first


def test_pairs_from_four_fifths_on_are_caught(spark):
    """Planted pairs of Jaccard similarity 0.8 to 0.9, of short texts and long ones."""
    rnd = random.Random(21)
    pairs, rows = [], []
    while len(pairs) < 150:
        n = rnd.choice([25, 40, 80, 300])
        base = prose(rnd, n).split()
        mine, edits = list(base), 0
        while True:
            mine[rnd.randrange(n)] = f"edit{rnd.random()}"
            edits += 1
            a, b = ({tuple(w[i : i + 5]) for i in range(n - 4)} for w in (base, mine))
            likeness = len(a & b) / len(a | b)
            if likeness < 0.9:
                break
        if likeness >= 0.8:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(mine))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.key: r.component_id for r in simhash.near_duplicates(docs, **corpus_pipeline.NEAR).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(abs(k - c) <= 1 for k, c in got.items())


def brute_alike(texts, k, alike):
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for t in texts)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= alike * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_empty(no_docs):
    out = simhash.near_duplicates(no_docs)
    assert out.columns == ["key", "words", "component_id"] and out.count() == 0
    assert simhash.one_of_each(no_docs, shingle=5, words=8, radius=94, deal="minima", bands=8).columns == no_docs.columns


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (1001, 1000)], "u bigint, v bigint")
    found = {r.node: r.root for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
