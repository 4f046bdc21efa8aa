"""Approximate nearest neighbours by multiprobe p-stable hashing, largest inner product first.

Largest inner product becomes least distance once each vector gets a component that brings its norm to the largest
one, and each query is scaled to that norm. A table hashes a vector by a few random projections, each cut into cells of
equal width. For a query the cells around its own are visited in the order of the estimated probability that a
neighbour lies there: along each projection a neighbour is normally distributed around the query, and the best sums of
log probabilities are found by extending the best partial sums, projection by projection. The candidates of all tables
are merged and ranked by their exact inner products.

Rows and queries are shuffled by table and bucket. The buckets of a table are dealt into parts of about SLICE rows, by
their hash; a bucket that holds more than a quarter of that is a part of its own, and cut by a hash of the id if it holds
more than that. A query goes to the parts that have buckets it visits, with those buckets' keys, and to no others. With
fewer parts than tasks the queries are dealt into blocks, and each block of a part is a task's work. The best of all
parts and tables are merged by id. How many buckets a query visits in a table is fitted on a bounded sample of SAMPLE
queries and their true neighbours, found by brute force against all rows, so that RECALL of these are found; if even
MOST_CELLS would not do, the rows are dealt by a hash of their id instead and searched whole, in blocks.

Equal vectors are one class, of which at most k + 1 rows can be among the k nearest; the least ids are those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: Tables, and the width of a cell in units of the largest norm.
TABLES, WIDTH = 10, 1.8
#: Queries whose true neighbours fit the number of cells, and the share of them to be found.
SAMPLE, RECALL = 96, 0.96
MOST_CELLS = 3000
#: Rows of a part, and parts at least.
SLICE, LEAST_TASKS = 100_000, 8
SEED = 20240
#: Steps along one projection that are considered.
STEPS = np.arange(-2, 3)


@dataclass
class Index:
    """Random projections and what was fitted: spread, a neighbour's distance; cells, visits in each table (0: all)."""

    dim: int
    norm: float
    bits: int
    spread: float = 1.0
    cells: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.lines = rng.standard_normal((TABLES, self.bits, self.dim + 1))
        self.shift = rng.random((TABLES, self.bits))
        self.codes = rng.integers(1, 1 << 62, (TABLES, self.bits), dtype=np.int64) | 1

    def _cells(self, v: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tbd->ntb", v, self.lines) / WIDTH + self.shift

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """(n, tables): the cell of each vector in each table."""
        rest = np.sqrt(np.maximum(0, self.norm**2 - (vectors**2).sum(axis=1)))
        at = np.floor(self._cells(np.column_stack([vectors, rest]) / self.norm)).astype(np.int64)
        return (at * self.codes).sum(axis=2)

    def probes(self, queries: np.ndarray, cells: int) -> np.ndarray:
        """(n, tables, cells): cells in the order of estimated success."""
        scaled = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at = self._cells(np.column_stack([scaled, np.zeros(len(queries))]))
        own = np.floor(at)
        low = own[..., None] + STEPS - at[..., None]  # of a cell, from the query
        scale = WIDTH / (self.spread * math.sqrt(2))
        cost = -np.log(np.maximum(_erf((low + 1) * scale) - _erf(low * scale), 1e-12))
        n = len(queries)
        best = np.zeros((n, TABLES, 1))
        keys = (own.astype(np.int64) * self.codes).sum(axis=2)[..., None]
        for b in range(self.bits):
            more = (best[..., None] + cost[:, :, None, b, :]).reshape(n, TABLES, -1)
            moved = (keys[..., None] + STEPS * self.codes[:, b][:, None, None]).reshape(n, TABLES, -1)
            if more.shape[2] > cells:
                least = np.argpartition(more, cells - 1, axis=2)[..., :cells]
                more, moved = np.take_along_axis(more, least, 2), np.take_along_axis(moved, least, 2)
            best, keys = more, moved
        return np.take_along_axis(keys, np.argsort(best, axis=2, kind="stable"), 2)


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function, to 1e-7 (Abramowitz and Stegun, 7.1.26)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _fit(classes: DataFrame, index: Index, k: int) -> None:
    """Set spread and cells by the true neighbours of a sample of queries."""
    some = classes.where("is_query").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "v").collect()
    asked, ids = np.array([r["v"] for r in some], dtype=np.float64), np.array([r["rep"] for r in some], dtype=np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, x = b.column(0).to_numpy(), _matrix(b.column(1))
            scores = asked @ x.T
            scores[ids[:, None] == reps[None, :]] = -np.inf
            best = [_top(s, reps, k) for s in scores]
            at, row = np.repeat(np.arange(len(asked)), [len(x) for x in best]), np.concatenate(best)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(scores[at, row]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["q", "score", "rep", "v"])

    found = classes.select("rep", "v").mapInArrow(nearest, "q bigint, score double, rep bigint, v array<double>").where(F.col("score") > float("-inf"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect()  # SAMPLE * k rows
    if not true:
        return
    q, x = np.array([r["q"] for r in true]), np.array([r["v"] for r in true], dtype=np.float64)
    unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
    cosine = (unit[q] * x).sum(axis=1) / index.norm
    index.spread = max(0.05, float(np.sqrt(np.maximum(0, 2 - 2 * cosine)).mean()))
    keys, needed = index.keys(x), np.full(len(q), MOST_CELLS + 1)
    for a in range(len(asked)):
        mine = np.flatnonzero(q == a)
        order_ = index.probes(asked[a : a + 1], MOST_CELLS)[0]
        for t in range(TABLES):
            place = {key: i for i, key in reversed(list(enumerate(order_[t].tolist())))}
            needed[mine] = np.minimum(needed[mine], [place.get(x, MOST_CELLS) + 1 for x in keys[mine, t].tolist()])
    cells = int(np.sort(needed)[min(len(needed) - 1, math.ceil(RECALL * len(needed)))])
    index.cells = cells if cells <= MOST_CELLS else 0


@dataclass
class Dealt:
    """Where buckets go. large: (table, key) -> the parts that a large bucket is cut into; at most 4 * TABLES for each SLICE rows."""

    parts: int
    blocks: int
    large: dict[tuple[int, int], int]

    def units(self, table: int, keys: np.ndarray) -> np.ndarray:
        """The first unit of each bucket: below ``parts`` they are shared, above they belong to a large bucket alone."""
        x = (keys.view(np.uint64) + np.uint64(table)) * np.uint64(0x9E3779B97F4A7C15)
        out = ((x >> np.uint64(33)) % np.uint64(self.parts)).astype(np.int64) * TABLES + table
        if mine := self.first[table]:
            for i in np.flatnonzero(np.isin(keys, self.keys[table])):
                out[i] = mine[int(keys[i])]
        return out

    def __post_init__(self):
        self.first, at = [{} for _ in range(TABLES)], self.parts * TABLES
        for (table, key), cuts in sorted(self.large.items()):
            self.first[table][key] = at
            at += cuts
        self.keys = [np.array(list(x), dtype=np.int64) for x in self.first]


def _mix(x: np.ndarray, n: int) -> np.ndarray:
    h = (x.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _entries(index: Index, dealt: Dealt):
    """Classes to rows (unit, block, kind, rep, v, keys): vectors to their bucket in each table, queries to the units that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                reps, x, asks = b.column("rep").to_numpy(), _matrix(b.column("v")), b.column("is_query").to_numpy(zero_copy_only=False)
                rows: list[tuple[int, int, int, int, list[int]]] = []  # unit, block, kind, row, keys
                keys = index.keys(x) if index.cells else np.zeros((len(x), 1), dtype=np.int64)
                salts = {cuts: _mix(reps, cuts) for cuts in set(dealt.large.values())}
                for t in range(TABLES if index.cells else 1):
                    unit = dealt.units(t, keys[:, t]) if index.cells else _mix(reps, dealt.parts)
                    for i in range(len(x)):
                        k = int(keys[i, t])
                        at = int(unit[i]) + (int(salts[dealt.large[t, k]][i]) if (t, k) in dealt.large else 0)
                        rows += [(at, block, 0, i, [k]) for block in range(dealt.blocks)]
                asked = np.flatnonzero(asks)
                if len(asked):
                    block = _mix(reps[asked] + 1, dealt.blocks)
                    probes = index.probes(x[asked], index.cells) if index.cells else None
                    for j, i in enumerate(asked.tolist()):
                        if probes is None:
                            rows += [(unit, int(block[j]), 1, i, []) for unit in range(dealt.parts)]
                            continue
                        for t in range(TABLES):
                            visit = probes[j, t]
                            unit = dealt.units(t, visit)
                            order = np.argsort(unit, kind="stable")
                            edges = [0, *(np.flatnonzero(np.diff(unit[order])) + 1).tolist(), len(order)]
                            for p, q in zip(edges, edges[1:], strict=False):
                                some = visit[order[p:q]]
                                cuts = dealt.large.get((t, int(some[0])), 1) if int(unit[order[p]]) >= dealt.parts * TABLES else 1
                                rows += [(int(unit[order[p]]) + c, int(block[j]), 1, i, some.tolist()) for c in range(cuts)]
                unit, block, kind, row, held = zip(*rows, strict=True)
                at = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(block, pa.int32()), pa.array(kind, pa.int32()), b.column("rep").take(at), b.column("v").take(at), pa.array(held, pa.list_(pa.int64()))], ["unit", "block", "kind", "rep", "v", "keys"])

    return run


ENTRIES = "unit bigint, block int, kind int, rep bigint, v array<double>, keys array<bigint>"


def _searched(index: Index, k: int):
    """Units, vectors first and then queries, to each query's best k + 1 classes among the candidates of the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def built():
            ids, x, keys = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(keys, kind="stable")
            return ids[order], x[order], x[order].astype(np.float32), keys[order]

        def answered(asker: np.ndarray, q: np.ndarray, visits: pa.Array) -> pa.RecordBatch | None:
            ids, x, light, keys = ready
            out: list[tuple[np.ndarray, ...]] = []
            ends, flat = visits.offsets.to_numpy(), visits.values.to_numpy()
            for i in range(len(asker)):
                if index.cells:
                    visit = flat[ends[i] : ends[i + 1]]
                    low, high = np.searchsorted(keys, visit, "left"), np.searchsorted(keys, visit, "right")
                    n = high - low
                    row = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                else:
                    row = np.arange(len(ids))
                if len(row) > 8 * k:  # single precision tells which can't be among the best; the rest are scored in double
                    rough = light[row] @ q[i].astype(np.float32)
                    least = np.partition(rough, len(row) - k - 1)[len(row) - k - 1] - 1e-4 * index.norm * np.linalg.norm(q[i])
                    row = row[rough >= least]
                scores = (x[row] * q[i]).sum(axis=1)
                best = _top(scores, ids[row], k + 1)
                out.append((np.full(len(best), asker[i]), ids[row][best], scores[best]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q_rep", "rep", "score"]) if out else None

        for b in batches:
            unit, block, kind = (b.column(c).to_numpy() for c in ("unit", "block", "kind"))
            new = np.flatnonzero((np.diff(unit) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(unit)], strict=True):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if (unit[lo], block[lo]) != now:
                    now, held, ready = (unit[lo], block[lo]), [], None
                ids, x = part.column("rep").to_numpy(), _matrix(part.column("v"))
                if kind[lo] == 0:
                    held.append((ids, x, part.column("keys").flatten().to_numpy()))
                elif held:
                    ready = ready or built()
                    if (made := answered(ids, x, pa.concat_arrays([part.column("keys")]))) is not None:
                        yield made

    return run


def _buckets(classes: DataFrame, index: Index) -> dict[tuple[int, int], int]:
    """Buckets that hold more than a quarter of SLICE rows, with the parts that they are cut into."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keys = index.keys(_matrix(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(keys))), pa.array(keys.ravel())], ["table", "key"])

    counted = classes.select("v").mapInArrow(of, "table int, key bigint").groupBy("table", "key").count().where(F.col("count") > SLICE // 4)
    return {(r["table"], r["key"]): -(-r["count"] // SLICE) for r in counted.collect()}  # at most 4 * TABLES for each SLICE rows


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every``, its k nearest others.

    vectors has vec_id and embedding. Nearness is the inner product in double precision, ties go to the smaller vec_id,
    and with fewer than k others all are returned. Rows take no part if the vec_id is null, or the vector is null,
    empty, zero, or has a null or non-finite component, or not as many components as the valid row of least vec_id,
    the shortest if several share that id.
    Repeated rows count once; of different vectors under one vec_id the least, compared by components, stands. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    found = rows.agg(F.min(F.struct("vec_id", F.size("v").alias("dim")))["dim"].alias("dim"), F.count(F.lit(1)).alias("n")).first()
    if not found["n"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == found["dim"]).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).groupBy("vec_id").agg(F.min("v").alias("v"))
    classes = durable(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("is_query")))
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = classes.agg(F.max(squares).alias("most"), F.count(F.lit(1)).alias("n"), F.max("is_query").alias("asked")).first()
    if not whole["asked"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index = Index(found["dim"], math.sqrt(whole["most"]) * (1 + 1e-12), max(4, round(math.log2(whole["n"])) - 6))
    _fit(classes, index, k)
    parts = -(-whole["n"] // SLICE)
    dealt = Dealt(parts, -(-LEAST_TASKS // (parts * (TABLES if index.cells else 1))), _buckets(classes, index) if index.cells and parts > 1 else {})
    entries = classes.mapInArrow(_entries(index, dealt), ENTRIES)
    n = min(2 * (parts * TABLES + sum(dealt.large.values())) * dealt.blocks, 20_000)
    ordered = entries.repartition(n, "unit", "block").sortWithinPartitions("unit", "block", "kind")
    found = ordered.mapInArrow(_searched(index, k), "q_rep bigint, rep bigint, score double")
    hits = found.groupBy("q_rep", "rep").agg(F.max("score").alias("score"))  # found in several tables
    best = Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    hits = durable(hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r"))
    # back from classes to rows: the k + 1 least ids of a class, and all queries of it
    of = rows.join(classes.select("v", "rep"), "v").select("vec_id", "rep")
    least = Window.partitionBy("rep").orderBy("vec_id")
    members = of.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1).drop("r")
    lists = hits.join(members, "rep")
    first = Window.partitionBy("q_rep").orderBy(F.desc("score"), "vec_id")
    lists = lists.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("q_rep", "vec_id", "score")
    lists = durable(lists)  # so that a vector that many rows ask with can be split in the join
    asking = of.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q_rep"))
    pairs = asking.join(lists, "q_rep").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
