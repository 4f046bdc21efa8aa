import numpy as np
from colloquy.llm import ann


def brute(ids, x, k=20, every=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)], "vec_id bigint, embedding array<float>")


def run(df):
    out = {}
    for r in ann.nearest(df).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert all([r for r, *_ in sorted(v)] == list(range(1, len(v) + 1)) for v in out.values())
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 24)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    ids = np.arange(1500)
    got, want = run(frame(spark, ids, x)), brute(ids, x.astype(np.float64))
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit / (20 * len(want)) >= 0.9
    score = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(abs(s - score[q, i]) < 1e-9 for q, v in got.items() for i, s in v if (q, i) in score)
    assert all(s == sorted(s, reverse=True) for s in ([y for _, y in v] for v in got.values()))


def test_parts_and_large_buckets(spark, monkeypatch):
    """Clusters, one of them a third of all rows: queries go to the parts of their buckets, large buckets are cut."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((24, 16))
    of = np.where(np.arange(1800) % 3 == 0, 0, rng.integers(0, 24, 1800))
    x = (centres[of] + 0.15 * rng.standard_normal((1800, 16))).astype(np.float32)
    ids = np.arange(1800)
    want = brute(ids, x.astype(np.float64))
    seen = {}
    for name in ("_entries", "_buckets"):
        real = getattr(ann, name)
        monkeypatch.setattr(ann, name, lambda *a, real=real, name=name: seen.setdefault(name, (a, real(*a)))[1])
    monkeypatch.setattr(ann, "SLICE", 150)
    got = run(frame(spark, ids, x))
    index, dealt = seen["_entries"][0]
    assert index.cells and dealt.parts == 12 and dealt.large and max(dealt.large.values()) > 1
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / (20 * len(want)) >= 0.9
    visits = [len(set(dealt.units(t, index.probes(x[q : q + 1].astype(float), index.cells)[0, t]).tolist())) for q in list(want)[:20] for t in range(ann.TABLES)]
    assert np.mean(visits) < dealt.parts
    seen.clear()
    monkeypatch.setattr(ann, "MOST_CELLS", 0)
    assert {q: [i for i, _ in v] for q, v in run(frame(spark, ids, x)).items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert not seen["_entries"][0][0].cells


def test_many_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x[50:250] = x[50]
    ids = np.arange(400)
    got, want = run(frame(spark, ids, x)), brute(ids, x.astype(np.float64))
    for q in range(60, 250, 20):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_rows_that_take_no_part(spark):
    df = spark.sql("""select * from values (0L, array(1f, 0f)), (20L, array(0f, 0f)), (40L, cast(null as array<float>)), (60L, array(1f, cast(null as float))), (80L, array(float('nan'), 1f)),
        (100L, array(float('inf'), 1f)), (120L, cast(array() as array<float>)), (1L, array(0.5f, 0.5f)), (2L, array(1f, 0f)), (3L, array(1f, 2f, 3f)), (cast(null as bigint), array(1f, 1f)), (1L, array(0.5f, 0.5f)) as t(vec_id, embedding)""")
    assert run(df) == {0: [(2, 1.0), (1, 0.5)]}
    assert ann.nearest(df.where("false")).count() == 0
    assert ann.nearest(df.where("vec_id = 1")).count() == 0
    assert run(df.where("vec_id = 0")) == {}


def test_cells_are_visited_by_estimated_success():
    index = ann.Index(4, 1.0, 5, spread=0.8, cells=40)
    q = np.array([[0.5, 0.1, -0.3, 0.2]])
    keys = index.probes(q, 40)[0]
    scaled = np.append(q[0] / np.linalg.norm(q[0]), 0)
    at = index._cells(scaled[None])[0]
    own = (np.floor(at).astype(np.int64) * index.codes).sum(axis=1)
    assert len(set(keys[0].tolist())) == 40
    assert all(own[t] in keys[t] for t in range(ann.TABLES))


def test_of_vectors_under_one_id_the_least_stands(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((60, 4)).astype(np.float32)
    ids = np.arange(60)
    other = [(int(i), [float(y) for y in x[i] + (1 if i % 2 else -1)]) for i in ids[::7]]
    odd = [(0, [9.0] * 5), (0, [float("nan")] * 4)]  # longer than another of id 0; not finite
    rows = [(int(i), [float(y) for y in v]) for i, v in zip(ids, x, strict=True)] + other + odd
    least = np.array([min(v for i, v in rows if i == n and len(v) == 4 and v[0] == v[0]) for n in range(60)])
    score = {q: dict(v) for q, v in brute(ids, least, k=60).items()}
    found = [run(spark.createDataFrame(some, "vec_id bigint, embedding array<float>").repartition(parts)) for some, parts in ((rows, 1), (rows[::-1], 5))]
    assert found[0] == found[1] and set(found[0]) == set(score)  # however the rows are dealt
    for q, v in found[0].items():  # the search is approximate, so it is scores that tell which vector stands
        assert all(abs(s - score[q][i]) < 1e-9 for i, s in v)
        top = set(sorted(score[q], key=lambda i: (-score[q][i], i))[:20])
        assert len(top & {i for i, _ in v}) >= 18
