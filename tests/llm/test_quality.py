import random
import zlib

import numpy as np
from colloquy.llm import quality
from pyspark.sql import functions as F

from .conftest import prose


def labelled(spark, n=400):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        text = prose(rnd, rnd.randint(20, 120))
        bad = i % 5 == 0
        if bad:
            text = " ".join(w + rnd.choice(["***", "%%%", "!!"]) for w in text.split())
        rows.append((i, text, int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id bigint, quality int, toxic int"), {i: q for i, _, q in rows}


def test_held_out_accuracy(spark):
    docs, labels, truth = labelled(spark)
    scored = quality.scored(docs, quality.train(docs, labels)).withColumn("out", quality.held_out(F.col("doc_id"))).collect()
    assert {r.doc_id for r in scored if r.out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    out = [r for r in scored if r.out]
    assert np.mean([(r.score >= quality.KEEP) == truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_held_out_labels_are_not_seen(spark):
    docs, labels, _ = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.train(docs, labels) == quality.train(docs, flipped)).all()


def test_a_long_text_is_scored_whole():
    rng = np.random.default_rng(1)
    w = rng.standard_normal((1 << quality.BITS) + 1).astype(np.float32)
    text = prose(random.Random(2), 3000)
    places = np.concatenate(list(quality.features(text)))
    assert np.isclose(quality.dot(text, w), w[places].sum(dtype=np.float64) / np.sqrt(len(places)), rtol=1e-4)
    at, x = quality._counted(text)
    assert np.isclose((w[at] * x).sum(), quality.dot(text, w), rtol=1e-3)


def test_features_do_not_depend_on_the_parts(monkeypatch):
    text = prose(random.Random(3), 400) + " " + "x" * 90 + "!?!" * 20 + " \n\n  end it's"
    whole = [np.sort(np.concatenate(list(quality.features(text))))]
    for part in (1, 2, 3, 7, 50, 1000):
        monkeypatch.setattr(quality, "PART", part)
        whole.append(np.sort(np.concatenate(list(quality.features(text)))))
    assert all((w == whole[0]).all() for w in whole)
    monkeypatch.undo()
    long = prose(random.Random(4), 1 << 18)
    assert len(long) > quality.PART
    n = len(quality.WORDS(long))
    assert sum(map(len, quality.features(long))) == 3 * n - 3


def dense(rows, size, epochs):
    """The updates as they are written in the literature, over whole vectors; the bias is a feature without penalties."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1, l2 = np.append(np.full(size, quality.L1), 0), np.append(np.full(size, quality.L2), 0)

    def weights():
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + l2))

    for _ in range(epochs):
        for places, values, y in rows:
            x = np.append(np.bincount(places, weights=values, minlength=size), 1.0)
            w = weights()
            g = (1 / (1 + np.exp(-w @ x)) - y) * x
            s = (np.sqrt(n + g * g) - np.sqrt(n)) / quality.ALPHA
            z += g - s * w
            n += g * g
    return weights()


def test_training_is_the_dense_updates():
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        places = rng.choice(60, rng.integers(1, 20), replace=False).astype(np.int32)
        rows.append((places, rng.random(len(places)).astype(np.float32), k % 3 != 0))
    got, want = quality.fit(rows), dense(rows, 1 << quality.BITS, quality.EPOCHS)
    assert np.abs(got - want).max() < 1e-5 and np.count_nonzero(got) > 10


def test_update_by_hand():
    """One row, one feature: the first step of the updates."""
    w = quality.fit.__globals__["EPOCHS"]
    quality.fit.__globals__["EPOCHS"] = 1
    try:
        out = quality.fit([(np.array([3], np.int32), np.array([2.0], np.float32), 1)])
    finally:
        quality.fit.__globals__["EPOCHS"] = w
    g, n = -0.5 * 2, 1.0
    want = -(g + quality.L1) / ((quality.BETA + np.sqrt(n)) / quality.ALPHA + quality.L2)
    assert np.isclose(out[3], want) and np.count_nonzero(out[:-1]) == 1


def test_odd_rows(spark, odd_docs, no_docs):
    docs, labels, _ = labelled(spark)
    w = quality.train(docs, labels)
    got = quality.scored(odd_docs, w).collect()
    assert len(got) == odd_docs.count() and quality.scored(no_docs, w).count() == 0
    bias = 1 / (1 + np.exp(-float(w[-1])))
    assert all(np.isclose(r.score, bias) for r in got if not (r.text or "").strip())
    assert quality.train(docs, labels.where("false")) is None and quality.train(no_docs, labels) is None
    assert {r.score for r in quality.scored(odd_docs, None).collect()} == {0.5}
