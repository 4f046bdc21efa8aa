import random

import corpus_pipeline
import pytest

from .conftest import prose


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(12)
    base = [prose(rnd, 40) for _ in range(8)]
    rows, bad = [], set()
    for i in range(200):
        text = "\n".join(prose(rnd, rnd.randint(15, 40)) for _ in range(4))
        if i % 4 == 1:
            text = " ".join(w + "%%%" for w in text.split(" "))
            bad.add(i)
        elif i % 10 == 2:
            text += "\nAll rights reserved by the owners of this"
        rows.append((i, text, "en", "src", len(text)))
    copy = "\n".join(base)
    rows += [(500 + i, copy, "en", "hot", len(copy)) for i in range(30)]
    rows += [(600 + i, copy.replace(base[i], base[i][:-1] + "zz"), "en", "hot", len(copy)) for i in range(3)]
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(200)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, bad


def test_stages(spark, tables):
    d, rows, bad = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_filter", "line_dedup", "near_dedup", "pack"]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], d))
        assert seen[-1].columns == docs.columns
    kept = {r.doc_id for r in seen[1].collect()}
    clean = {r[0] for r in rows} - bad
    assert len(clean - kept) <= 2 and len(bad & kept) <= 2
    texts = {r.doc_id: r.text for r in seen[2].collect()}
    assert set(texts) == kept and not any("All rights reserved" in t for t in texts.values())
    assert texts[500] == rows[200][1]
    one = {r.doc_id for r in seen[3].collect()}
    assert kept - one == set(range(501, 530)) | {600, 601, 602}


def test_against_brute_force(spark, tables):
    """Each stage by plain loops over what the one before kept; the result is compared with the whole run's."""
    import zlib

    import numpy as np
    import public_tokenizers
    from colloquy.llm import quality
    from tokenizers import Tokenizer

    from .test_linededup import slow
    from .test_packing import best_fit
    from .test_simhash import brute_alike

    d, rows, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    w = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r[0]: r[1] for r in rows if 1 / (1 + np.exp(-(quality.dot(r[1], w) + float(w[-1])))) >= quality.KEEP}
    clean = slow(good)
    ids = sorted(clean)
    label = brute_alike([clean[i].lower() for i in ids], 5, 0.8)
    left = [i for k, i in enumerate(ids) if label[k] == k]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want, lengths = [], []
    for i in left:
        tokens = [*library.encode(clean[i], add_special_tokens=False).ids, 0]
        first = len(tokens) % corpus_pipeline.CAPACITY or corpus_pipeline.CAPACITY
        cuts = [0, *range(first, len(tokens) + 1, corpus_pipeline.CAPACITY)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())))
            lengths.append(b - a)
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({r.sequence_id for r in got}) == best_fit(lengths, corpus_pipeline.CAPACITY)


def test_odd_documents_pass_all_stages(spark, odd_docs, no_docs, tables):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table: columns stay, and nothing fails."""
    d, *_ = tables
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, d)
            assert docs.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
        assert packed.select("doc_id", "piece").distinct().count() <= packed.count() and (packed.count() == 0) == (docs.count() == 0)


def test_run_packs_what_is_left(spark, tables):
    d, *_ = tables
    out = corpus_pipeline.run(spark, d)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= corpus_pipeline.CAPACITY
