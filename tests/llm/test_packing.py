import random
import zlib

import numpy as np
import public_tokenizers
from colloquy.llm import packing
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, left in enumerate(bins) if left >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


def test_plan_is_best_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(200):
        capacity = rnd.choice([1, 5, 10, 64, 100])
        lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        bins = {}
        for n, ranges in packing.plan(counts, capacity).items():
            for (a, first, offset), (b, *_) in zip(ranges, [*ranges[1:], (counts[n], 0, 0)], strict=True):
                for k in range(a, b):
                    bins.setdefault(first + k - a, []).append((offset, n))
        for b in bins.values():
            end = 0
            for offset, n in sorted(b):
                assert offset == end
                end += n
            assert end <= capacity
        assert sum(map(len, bins.values())) == len(lengths) and len(bins) == best_fit(lengths, capacity)


def test_tightest_open_place():
    tree, marked = packing.Tightest(50), set()
    rnd = random.Random(1)
    for _ in range(500):
        at = rnd.randint(0, 50)
        tree.mark(at, on := rnd.random() < 0.4)
        (marked.add if on else marked.discard)(at)
        ask = rnd.randint(0, 50)
        assert tree.least_from(ask) == min((m for m in marked if m >= ask), default=None)


def test_a_common_length_is_ranked_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "one two") for i in range(300)] + [(i, "x " * (i % 40)) for i in range(300, 400)], "doc_id bigint, text string").repartition(5)
    whole = packing.packed(docs, FILE, 32).collect()
    monkeypatch.setattr(packing, "PART_ROWS", 7)
    parts = packing.packed(docs, FILE, 32).collect()
    for rows in (whole, parts):
        by = {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert all(sum(n for _, n in x) <= 32 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in by.values())
    assert len(whole) == len(parts) > 400 and len({r.sequence_id for r in whole}) == len({r.sequence_id for r in parts})


def test_packed_documents(odd_docs, no_docs):
    library = Tokenizer.from_file(FILE)
    capacity = 64
    rows = packing.packed(odd_docs, FILE, capacity, end_id=0).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for some in by.values():
        end = 0
        for offset, n in sorted(some):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(by) == best_fit([r.length for r in rows], capacity)
    assert packing.packed(no_docs, FILE).count() == 0
