import datetime as dt
import math
import random

import numpy as np
from colloquy.llm import rolling

WINDOW = 1000


def middle(values):
    values = sorted(values)
    return values[(len(values) - 1) // 2] + values[len(values) // 2]


def slow(rows):
    out = []
    for i, series, ts, value in rows:
        if ts is None:
            continue
        held = [v for _, s, t, v in rows if s == series and t is not None and ts - WINDOW <= t <= ts and v is not None]
        m = middle(held) if len(held) >= rolling.LEAST else None
        out.append((i, series, ts, value, len(held), m, None if m is None else middle([abs(2 * v - m) for v in held])))
    return sorted(out, key=str)


def test_a_piece_against_sorting(monkeypatch):
    """Events of all kinds, with values from a few to very far apart, and tables cut into single digits and moments."""
    rnd = np.random.default_rng(1)
    for trial in range(150):
        n = int(rnd.integers(1, 100))
        role, pos, times = rnd.choice([0, 1, -1], n), rnd.integers(0, 60, n), rnd.integers(1, 4, n)
        value, known = (rnd.standard_t(1.5, n) * rnd.choice([3, 50, 3000, 10**6])).astype(np.int64), rnd.random(n) < 0.9
        monkeypatch.setattr(rolling, "CELLS", int(rnd.choice([64, 1 << 18])))
        monkeypatch.setattr(rolling, "HIGH_DIGITS", int(rnd.choice([4, 1024])))
        want = []
        for t in pos[role == rolling.ENTERS]:
            inside = known & ((role == 0) | ((role == 1) & (pos <= t)) | ((role == -1) & (pos > t)))
            held = np.repeat(value[inside], times[inside]).tolist()
            m = middle(held) if len(held) >= rolling.LEAST else 0
            want.append((len(held), m, middle([abs(2 * v - m) for v in held]) if len(held) >= rolling.LEAST else 0))
        assert list(zip(*[x.tolist() for x in rolling.medians(role, pos, value, known, times)], strict=True)) == want, trial


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, series string, ts bigint, value bigint").repartition(5)


def test_blocks_and_pieces_against_sorting(spark):
    """A busy series with a moment that a third of its rows share, sparse ones, a null one, times before 1970, nulls and repeated rows."""
    rnd = random.Random(3)
    rows = [(i, "hot", rnd.randint(-9000, 9000), rnd.randint(0, 300)) for i in range(500)] + [(1000 + i, "hot", 4321, rnd.randint(0, 9)) for i in range(250)]
    rows += [(2000 + i, rnd.choice(["a", "b", None, ""]), rnd.randint(-20_000, 20_000), rnd.choice([None, 5, 10**9, -(10**7), rnd.randint(0, 50)])) for i in range(200)]
    rows += [(3000, "a", None, 4), (3001, "none", 7, None), (None, "hot", 17, 4), rows[0], rows[0]]
    rows += [(4000 + i, "edge", k * WINDOW + x, i) for i, (k, x) in enumerate((k, x) for k in range(3, 9) for x in (-1, 0, 1))]
    want = slow(rows)
    for piece_rows in (rolling.PIECE_ROWS, 60):
        got = rolling.rolled(table(spark, rows), WINDOW, piece_rows).collect()
        assert sorted(((r.id, r.series, r.ts, r.value, r.n, r.median2, r.mad4) for r in got), key=str) == want, piece_rows
    assert rolling.rolled(table(spark, rows[:0]), WINDOW).count() == 0


def test_clicks(spark):
    rnd = random.Random(8)
    at = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    hour = 3_600_000_000
    clicks = [(i, at(rnd.randint(0, 40 * hour)), rnd.choice(["view", None]), rnd.choice([None, 1.005, 2.5, -0.125, 700.0, round(rnd.random() * 9, 2)])) for i in range(150)]
    clicks += [(500, at(0), "edge", 1.0), (501, at(6 * hour), "edge", 2.0), (502, at(6 * hour + 1), "edge", 3.0), (503, None, "edge", 1.0)]
    clicks += [(600 + k, at(k), "odd", v) for k, v in enumerate([math.nan, math.inf, 1e300, 1.0, 1.0, 2.0, 3.0, 9.0])] + [clicks[0], clicks[0], (500, at(5), "view", None)]
    made = spark.createDataFrame(clicks, "click_id bigint, ts timestamp_ntz, kind string, value double").selectExpr("*", "1 as n", "'x' as id")
    once = {}
    for i, ts, kind, value in clicks:
        key = (ts is None, ts, kind is None, kind or "", value is None, value or 0)
        if i not in once or key < once[i][0]:
            once[i] = key, kind, ts, value
    cents = lambda v: None if v is None or not math.isfinite(v) or abs(v) >= rolling.LARGEST / 100 else math.floor(100 * v + 0.5)
    rows = [(i, kind, None if ts is None else (ts - dt.datetime(2024, 1, 1)) // dt.timedelta(microseconds=1), cents(v)) for i, (_, kind, ts, v) in once.items()]
    want = {}
    for i, kind, ts, value in rows:
        if ts is not None:
            held = [v for _, k, t, v in rows if k == kind and t is not None and ts - 6 * hour <= t <= ts and v is not None]
            m = middle(held) if len(held) >= 5 else None
            mad = None if m is None else middle([abs(2 * v - m) for v in held])
            want[i] = kind, len(held), m, mad, None if m is None or value is None else 2 * abs(2 * value - m) > 5 * mad
    for piece_rows in (rolling.PIECE_ROWS, 40):
        got = rolling.clicks_apart(made, 360, piece_rows).collect()
        assert {r.click_id: (r.kind, r.n, r.median2, r.mad4, r.far) for r in got} == want and len(got) == len(want)
