"""A rolling exact median and median absolute deviation over time windows of series.

A series' rows are cut into blocks of ``SPAN`` windows. The rows of a block's last window also go to the next one as
its halo: a block and its halo give every window of the block. A block with more than ``PIECE_ROWS`` of them is cut
further, first into stretches as long as the window, whose rows enter in one and leave in the next, and then at quantiles
of time: a piece gets the rows that enter or leave in its own time, and of the rest of the window, which is in all of the
piece's windows, only how often each value occurs. Rows of such a block that agree in time and value are put together
first and joined back afterwards, so neither a burst nor a moment that very many rows share goes to one task.

Within a piece the window slides over a sparse two-level histogram: counts by a value's high digit, and for the few
high digits that matter counts by its low digit; only digits that occur are held. For many moments at once, the high
digit of the median is where the running counts pass the middle; its low digit is found within it. From there the
search expands outward, a high digit at a time on the nearer side, until it holds the middle of the deviations, and
ends within the digits at the two edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, stored

#: Windows of a block; rows of a block from which it is cut, and about so many in each piece; there are at most PIECES of a stretch.
SPAN, PIECE_ROWS, PIECES = 4, 131_072, 1024
#: Values in a window below which there is no median.
LEAST = 5
#: Bits of the low digit, at the least, and high digits of a piece, beyond which the low digit gets more bits.
LOW_BITS, HIGH_DIGITS = 7, 1024
#: Cells of a table of counts by moment and digit that are held at a time.
CELLS = 1 << 18
#: Values beyond are taken for missing: doubled deviations must be exact as longs.
LARGEST = 1 << 53
MIDDLE, ENTERS, LEAVES = 0, 1, -1


def micros(ts: Column) -> Column:
    """Exact microseconds since 1970 of a time without a zone, or of the session's clock."""
    day = F.unix_date(ts.cast("date")).cast("bigint") * 86_400_000_000
    return day + F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null for null, values that aren't finite, and such as are too large to double exactly."""
    scaled = F.floor(value.cast("double") * 100 + 0.5)
    return F.when(F.abs(value.cast("double")) < LARGEST / 100, scaled.cast("bigint"))


class _Slide:
    """Counts of a window's values while it slides over moments in ascending order."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        bits = LOW_BITS
        while len(np.unique(values >> bits)) > HIGH_DIGITS:
            bits += 1
        high = values >> bits
        self.start = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        self.end = np.append(self.start, len(values))[1:]
        self.digit = np.repeat(np.arange(len(self.start)), self.end - self.start)
        self.low, self.high = values[self.start], values[self.end - 1]
        self.now = np.zeros(len(values), dtype=np.int64)
        self.kind: type = np.int64

    def slide(self, n_moments: int, at: np.ndarray, code: np.ndarray, change: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """For moments 0.. in blocks: (number of values, doubled median, doubled deviation); events sorted by moment."""
        step = max(16, min(4096, CELLS // max(1, len(self.start))))
        for a in range(0, n_moments, step):
            b = min(a + step, n_moments)
            part = slice(np.searchsorted(at, a), np.searchsorted(at, b))
            yield from self._some(b - a, at[part] - a, code[part], change[part])

    def _some(self, m: int, at: np.ndarray, code: np.ndarray, change: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        found = self._found(m, at, code, change)
        if found is None:  # too many low digits at once: in halves
            half = np.searchsorted(at, m // 2)
            yield from self._some(m // 2, at[:half], code[:half], change[:half])
            yield from self._some(m - m // 2, at[half:] - m // 2, code[half:], change[half:])
            return
        np.add.at(self.now, code, change)
        yield found

    def _found(self, m: int, at: np.ndarray, code: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, ...] | None:
        n_high = len(self.start)
        if not n_high:
            return np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        by_high = np.bincount(at * n_high + self.digit[code], change, m * n_high).reshape(m, n_high).astype(self.kind)
        by_high[0] += np.add.reduceat(self.now, self.start)
        np.cumsum(by_high, axis=0, out=by_high)
        upto = np.zeros((m, n_high + 1), dtype=self.kind)  # values below a high digit
        np.cumsum(by_high, axis=1, out=upto[:, 1:])
        n = upto[:, -1]
        rows = np.flatnonzero(n >= LEAST)
        median, deviation = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        if len(rows):
            upto, n_ok = upto[rows], n[rows]
            ranks = (n_ok - 1) // 2, n_ok // 2
            digits = [(upto[:, 1:] <= r[:, None]).sum(axis=1) for r in ranks]
            place = np.full(n_high, -1)
            fine = self._fine(np.unique(np.concatenate(digits)), place, m, at, code, change)
            if fine is None:
                return None
            fine = fine[rows]
            two = sum(self._value(upto, fine, place, d, r) for d, r in zip(digits, ranks, strict=True))
            near, far = self._expanded(upto, digits, two, ranks)
            needed = self._edges(two, near, far)
            fine = self._fine(needed, place, m, at, code, change)
            if fine is None:
                return None
            fine = fine[rows]
            first = self._deviation(upto, fine, place, two, near, far, ranks[0])
            even = np.flatnonzero(ranks[0] != ranks[1])
            second = first.copy()
            second[even] = self._deviation(upto[even], fine[even], place, two[even], first[even], far[even], ranks[1][even])
            median[rows], deviation[rows] = two, first + second
        return n, median, deviation

    def _fine(self, digits: np.ndarray, place: np.ndarray, m: int, at: np.ndarray, code: np.ndarray, change: np.ndarray) -> np.ndarray | None:
        """Values up to each low digit within the high digits given, for each moment; place: each one's first column."""
        widths = self.end[digits] - self.start[digits]
        total = int(widths.sum())
        if m * total > 8 * CELLS and m > 16:
            return None
        place[:] = -1
        place[digits] = np.cumsum(widths) - widths
        own = place[self.digit[code]] >= 0
        column = place[self.digit[code[own]]] + code[own] - self.start[self.digit[code[own]]]
        out = np.bincount(at[own] * total + column, change[own], m * total).reshape(m, total).astype(self.kind)
        out[0] += np.concatenate([self.now[self.start[d] : self.end[d]] for d in digits])
        np.cumsum(out, axis=0, out=out)
        for d, w in zip(digits, widths, strict=True):
            part = out[:, place[d] : place[d] + w]
            np.cumsum(part, axis=1, out=part)
        return out

    def _value(self, upto: np.ndarray, fine: np.ndarray, place: np.ndarray, digit: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank, from 0, given its high digit."""
        out = np.zeros(len(rank), dtype=np.int64)
        rest = rank - upto[np.arange(len(rank)), digit]
        for d in np.unique(digit):
            rows = np.flatnonzero(digit == d)
            columns = fine[rows, place[d] : place[d] + self.end[d] - self.start[d]]
            out[rows] = self.values[self.start[d] + (columns <= rest[rows, None]).sum(axis=1)]
        return out

    def _expanded(self, upto: np.ndarray, digits: list[np.ndarray], two: np.ndarray, ranks: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest doubled deviation between which those of both ranks lie."""
        left, right = digits[0].copy(), digits[1].copy()
        far_off = np.iinfo(np.int64).max
        below, above = np.append(far_off, self.high), np.append(self.low, far_off)
        near, row = np.zeros(len(two), dtype=np.int64), np.arange(len(two))
        for rank, keep in ((ranks[0], True), (ranks[1], False)):
            active = row[upto[row, right + 1] - upto[row, left] <= rank]
            while len(active):
                x, y = left[active], right[active]
                down = np.where(x > 0, two[active] - 2 * below[x], far_off)
                up = np.where(y + 1 < len(self.low), 2 * above[np.minimum(y + 1, len(self.low))] - two[active], far_off)
                to_left = down <= up
                if keep:
                    near[active] = np.where(to_left, down, up)
                left[active] = np.where(to_left, x - 1, x)
                right[active] = np.where(to_left, y, y + 1)
                active = active[upto[active, right[active] + 1] - upto[active, left[active]] <= rank[active]]
        return near, np.maximum(two - 2 * self.low[left], 2 * self.high[right] - two)

    def _edges(self, two: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The high digits in which the search can end."""
        marks = np.zeros(len(self.low) + 1, dtype=np.int64)
        for a, b in (((two - far) // 2 - 1, (two - near) // 2 + 1), ((two + near) // 2 - 1, (two + far) // 2 + 1)):
            first, last = np.searchsorted(self.high, a), np.searchsorted(self.low, b, "right")
            some = first < last
            np.add.at(marks, first[some], 1)
            np.add.at(marks, last[some], -1)
        return np.flatnonzero(np.cumsum(marks)[:-1] > 0)

    def _upto(self, upto: np.ndarray, fine: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of each moment's values are at most value."""
        row, j = np.arange(len(value)), np.searchsorted(self.values, value, "right") - 1
        d = self.digit[np.maximum(j, 0)]
        whole = j == self.end[d] - 1
        within = np.where(whole, 0, fine[row, np.where(whole, 0, place[d] + j - self.start[d])])
        return np.where(j < 0, 0, np.where(whole, upto[row, d + 1], upto[row, d] + within))

    def _deviation(self, upto: np.ndarray, fine: np.ndarray, place: np.ndarray, two: np.ndarray, near: np.ndarray, far: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The doubled deviation of that rank: the least within which more than rank values lie."""
        low, high = near.copy(), far.copy()
        while (low < high).any():
            mid = (low + high) // 2
            inside = self._upto(upto, fine, place, (two + mid) // 2) - self._upto(upto, fine, place, -((mid - two) // 2) - 1)
            more = inside > rank
            high, low = np.where(more, mid, high), np.where(more, low, np.minimum(mid + 1, high))
        return low


def medians(role: np.ndarray, pos: np.ndarray, value: np.ndarray, known: np.ndarray, times: np.ndarray, stay: int | None = None) -> tuple[np.ndarray, ...]:
    """For each event that enters: (values in the window, doubled median, doubled deviation), of all windows of a piece.

    role: MIDDLE for values in all windows, ENTERS from pos on, LEAVES from pos on. known: whether there is a value.
    stay: how long what enters stays; if None, other events say when it leaves.
    """
    enters = role == ENTERS
    moments = np.unique(pos[enters])
    out = [np.zeros(len(moments), dtype=np.int64) for _ in range(3)]
    own = known & (times > 0)
    values, code = np.unique(value[own], return_inverse=True)
    window = _Slide(values)
    r, n, at = role[own], times[own], np.searchsorted(moments, pos[own])
    if n.sum() < 1 << 31:
        window.kind = np.int32
    there = r != ENTERS
    np.add.at(window.now, code[there], n[there])
    change = n * r
    if stay is not None:
        gone = r == ENTERS
        at = np.append(at, np.searchsorted(moments, pos[own][gone] + stay))
        code, change, r = np.append(code, code[gone]), np.append(change, -n[gone]), np.append(r, np.full(gone.sum(), LEAVES))
    moving = (r != MIDDLE) & (at < len(moments))
    order = np.argsort(at[moving], kind="stable")
    a = 0
    for some in window.slide(len(moments), at[moving][order], code[moving][order], change[moving][order]):
        for whole, part in zip(out, some, strict=True):
            whole[a : a + len(part)] = part
        a += len(some[0])
    where = np.searchsorted(moments, pos[enters])
    return tuple(x[where] for x in out)


def _piece(t: pa.Table, stay: int | None = None) -> pa.Table:
    """A piece's events -> its rows that enter, with what their windows hold."""
    column = lambda name: t[name].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    role = column("role")
    known = ~np.asarray(t["value"].combine_chunks().is_null())
    n, median, deviation = medians(role, column("pos"), column("value"), known, column("times"), stay)
    enough = pa.array(n < LEAST)
    own = t.filter(pa.array(role == ENTERS))
    return pa.table({"id": own["id"], "series": own["series"], "pos": own["pos"], "value": own["value"], "n": pa.array(n), "median2": pa.array(median, mask=np.asarray(enough)), "mad4": pa.array(deviation, mask=np.asarray(enough))})


#: What a piece takes and what it returns, besides the columns that name the series and the piece.
_OUT = "n bigint, median2 bigint, mad4 bigint"


def _busy(rows: DataFrame, window: int, piece_rows: int) -> DataFrame:
    """(series, block): the blocks with more than piece_rows rows, halo included."""
    counted = _blocks(rows.select("series", "ts"), window).groupBy("series", "block").agg(F.count(F.lit(1)).alias("rows"))
    return durable(counted.where(F.col("rows") > piece_rows).select("series", "block"))


def _cuts(events: DataFrame, piece_rows: int) -> DataFrame:
    """(series, stretch, cuts): times that cut each stretch into even pieces.

    A piece holds as many events as there are different values in its stretch, at the least, so that the counts of the
    rest of the window are no more than the events.
    """
    shares = [i / PIECES for i in range(1, PIECES)]
    found = events.groupBy("series", "stretch").agg(F.percentile_approx("pos", shares, PIECES * 10).alias("all"), F.count(F.lit(1)).alias("events"), F.approx_count_distinct("value").alias("values"))
    step = F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(piece_rows), "values") * PIECES / F.col("events"))).cast("int")
    return durable(found.withColumn("step", step).select("series", "stretch", F.expr("array_distinct(filter(all, (x, i) -> (i + 1) % step = 0))").alias("cuts")))


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys are equal; both sides are shuffled, so that a hot key can be split."""
    named = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named.hint("shuffle_merge"), on, how).drop(*[f"__{k}" for k in keys])


def _blocks(rows: DataFrame, window: int) -> DataFrame:
    """A row enters its own block; it leaves the next one, if that has windows that hold it."""
    span = SPAN * window
    own, next_ = F.expr(f"cast(floor(ts / {span}) as bigint)"), F.expr(f"cast(floor((ts + {window}) / {span}) as bigint)")
    enters = F.struct(F.lit(ENTERS).alias("role"), own.alias("block"), F.col("ts").alias("pos"))
    leaves = F.struct(F.lit(LEAVES).alias("role"), next_.alias("block"), (F.col("ts") + window + 1).alias("pos"))
    kept = [c for c in rows.columns if c != "ts"]
    return rows.select(*kept, F.explode(F.when(own == next_, F.array(enters)).otherwise(F.array(enters, leaves))).alias("e")).select(*kept, "e.*")


def _stretches(rows: DataFrame, window: int) -> DataFrame:
    """A row enters its own stretch, and leaves the next one when its time is more than a window ago."""
    own = F.expr(f"cast(floor(ts / {window}) as bigint)")
    enters = F.struct(F.lit(ENTERS).alias("role"), own.alias("stretch"), F.col("ts").alias("pos"))
    leaves = F.struct(F.lit(LEAVES).alias("role"), (own + 1).alias("stretch"), (F.col("ts") + window + 1).alias("pos"))
    kept = [c for c in rows.columns if c != "ts"]
    both = rows.select(*kept, F.explode(F.array(enters, leaves)).alias("e")).select(*kept, "e.*")
    return both.withColumn("block", F.expr(f"cast(floor(stretch / {SPAN}) as bigint)"))


def rolled(rows: DataFrame, window: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows(id, series, ts, value), longs but for series -> (id, series, ts, value, n, median2, mad4), one for each row.

    A row's window holds the values of its series with ts from its own minus ``window`` to its own; equal ones all
    count, and null ones don't. median2 is the sum of the two middle values in order, or twice the only middle one, and
    mad4 the same of |2 * value - median2|; both are null if n is under LEAST. A null series is a series. Rows without
    ts take no part. Repeated rows all count. An empty table gives an empty one.
    """
    rows = rows.where("ts is not null").select("id", "series", "ts", "value")
    kind = rows.schema["series"].dataType.simpleString()
    schema = f"id bigint, series {kind}, pos bigint, value bigint, {_OUT}"
    busy = _busy(rows, window, piece_rows)
    some = busy.limit(1).count() > 0
    if some:
        rows = stored(rows, "rows")
    quiet = _blocks(rows.withColumn("times", F.lit(1).cast("bigint")), window)
    if some:
        quiet = _on(quiet, busy, ["series", "block"], "left_anti")
    out = quiet.groupBy("series", "block").applyInArrow(lambda t: _piece(t, window + 1), schema)
    if some:
        out = out.unionByName(_cut(_on(_stretches(rows, window), busy, ["series", "block"], "left_semi"), piece_rows, schema))
    return out.withColumnRenamed("pos", "ts")


def _cut(events: DataFrame, piece_rows: int, schema: str) -> DataFrame:
    """The same for busy blocks: rows of one time and value together, in pieces, and joined back."""
    events = stored(events, "events")
    alike = durable(events.groupBy("series", "stretch", "role", "pos", "value").agg(F.count(F.lit(1)).alias("times")))
    placed = _on(alike, _cuts(alike, piece_rows), ["series", "stretch"], "inner")
    placed = durable(placed.select(*alike.columns, F.size(F.filter("cuts", lambda x: x <= F.col("pos"))).alias("piece"), F.size("cuts").alias("last")))
    # in the windows of a piece: what entered in pieces before it, and what leaves in pieces after it
    counts = placed.where("value is not null").groupBy("series", "stretch", "role", "piece", "last", "value").agg(F.sum("times").alias("times"))
    leaves = F.array(F.struct(F.lit(0).alias("from"), F.col("times").alias("n")), F.struct(F.col("piece").alias("from"), (-F.col("times")).alias("n")))
    enters = F.array(F.struct((F.col("piece") + 1).alias("from"), F.col("times").alias("n")))
    steps = counts.select("series", "stretch", "value", "last", F.explode(F.when(F.col("role") == ENTERS, enters).otherwise(leaves)).alias("s"))
    steps = steps.groupBy("series", "stretch", "value", "last", "s.from").agg(F.sum("s.n").alias("n")).where(F.col("from") <= F.col("last"))
    line = Window.partitionBy("series", "stretch", "value").orderBy("from")
    held = steps.withColumn("times", F.sum("n").over(line)).withColumn("to", F.lead("from", 1).over(line)).where("times > 0")
    pieces = F.sequence("from", F.coalesce(F.col("to") - 1, F.col("last")))
    middle = held.select("series", "stretch", F.lit(MIDDLE).alias("role"), F.lit(0).cast("bigint").alias("pos"), "value", "times", F.explode(pieces).alias("piece"))
    whole = placed.drop("last").unionByName(middle).withColumn("id", F.lit(None).cast("bigint"))
    found = stored(whole.groupBy("series", "stretch", "piece").applyInArrow(lambda t: _piece(t), schema), "moments")
    found = found.select("series", "pos", "value", "n", "median2", "mad4")
    rows = events.where(F.col("role") == ENTERS).select("id", "series", "pos", "value")
    return _on(rows, found, ["series", "pos", "value"], "inner").select("id", "series", "pos", "value", "n", "median2", "mad4")


def clicks_apart(clicks: DataFrame, minutes: int = 360, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(click_id, kind, n, median2, mad4, far): a click's window among those of its kind, and whether it is far off.

    A click_id counts once; of rows that share one, the first by time, then kind and cents, with nulls last; rows without a
    click_id are one. Clicks without ts are dropped. far: 2 * |2 * cents - median2| > 5 * mad4; null without cents or
    median. Other columns are not read.
    """
    own = clicks.select("click_id", micros(F.col("ts")).alias("ts"), "kind", cents(F.col("value")).alias("value"))
    first = F.min(F.struct(F.col("ts").isNull(), "ts", F.col("kind").isNull(), "kind", F.col("value").isNull(), "value"))
    once = own.groupBy("click_id").agg(first.alias("x"))
    rows = once.select(F.col("click_id").cast("bigint").alias("id"), F.col("x.kind").alias("series"), F.col("x.ts").alias("ts"), F.col("x.value").alias("value"))
    found = rolled(rows, minutes * 60_000_000, piece_rows)
    far = 2 * F.abs(2 * F.col("value") - F.col("median2")) > 5 * F.col("mad4")
    return found.select(F.col("id").alias("click_id"), F.col("series").alias("kind"), "n", "median2", "mad4", far.alias("far"))
