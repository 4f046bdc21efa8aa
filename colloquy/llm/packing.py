"""Best-fit decreasing packing of token sequences.

Best fit looks only at lengths, so the plan is made from the number of pieces of each length: a table of at most
``capacity`` rows, whatever the corpus. Bins with the same space left are alike and stay one range of sequence ids,
which is split where only a part of it gets a piece. A segment tree over the space left finds the tightest open range
for a length in logarithmic time. The plan says, for each length, which ranks go to which sequences at which offset;
pieces are ranked within their length in a distributed way and look their place up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, texts
from .wordcodes import byte_codes

#: The pieces of a length are ranked in parts of at least so many rows, of which there are at most PARTS in all besides
#: one for each length, so that a common length isn't ranked in one task.
PART_ROWS, PARTS = 1000, 100_000


class Tightest:
    """A segment tree over 0..size: the least marked place at or above a given one."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.marked = [False] * (2 * self.width)

    def mark(self, at: int, value: bool) -> None:
        at += self.width
        self.marked[at] = value
        while at > 1:
            at //= 2
            self.marked[at] = self.marked[2 * at] or self.marked[2 * at + 1]

    def least_from(self, at: int) -> int | None:
        at += self.width
        if self.marked[at]:
            return at - self.width
        while at > 1:
            if at % 2 == 0 and self.marked[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.marked[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """counts: pieces of each length -> for each length its (first rank, first sequence, offset) ranges, by rank.

    The pieces of a range take one sequence each, in order, up to the next range's first rank.
    """
    tree = Tightest(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> (first sequence, number) ranges
    out: dict[int, list[tuple[int, int, int]]] = {}
    sequences = 0

    def keep(space: int, first: int, n: int) -> None:
        if space:
            open_.setdefault(space, []).append((first, n))
            tree.mark(space, True)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank, ranges = counts[length], 0, []
        while left:
            space = tree.least_from(length)
            if space is None:  # one new bin at a time takes as many of these as fit; that is what best fit does, for all at once
                fit = capacity // length
                bins = -(-left // fit)
                whole = left // fit
                for k in range(fit):
                    n = whole if k >= left - whole * fit else bins
                    if n:
                        ranges.append((rank, sequences, k * length))
                        rank += n
                keep(capacity - fit * length, sequences, whole)
                if bins > whole:
                    keep(capacity - (left - whole * fit) * length, sequences + whole, 1)
                    # the last bin got the first pieces of each layer in which the whole ones got theirs
                sequences += bins
                left = 0
                break
            first, n = open_[space].pop()
            if not open_[space]:
                tree.mark(space, False)
            used = min(left, n)
            ranges.append((rank, first, capacity - space))
            rank, left = rank + used, left - used
            if used < n:
                open_[space].append((first + used, n - used))
                tree.mark(space, True)
            keep(space - length, first, used)
        out[length] = ranges
    return out


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each text's ids with end_id after them.

    Null texts are empty: one piece, the end id alone. Documents longer than a sequence are cut; the first piece is
    the short one. Rows with the same doc_id, or none, are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(vocabulary)
        tail = np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = codes.ids(text) + tail
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, stop in enumerate(range(first, n + 1, capacity)):
                    start = max(0, stop - capacity) if k else 0
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces with sequence_id and offset: no sequence has more than capacity ids, and none has a gap.

    An empty table gives an empty one. Only doc_id and text are read.
    """
    made = durable(pieces(docs, vocabulary, capacity, end_id).withColumn("own", F.monotonically_increasing_id()))
    whole = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}  # at most capacity rows
    each = max(PART_ROWS, sum(whole.values()) // PARTS)
    parts = {n: 1 + count // each for n, count in whole.items()}
    several = {n: p for n, p in parts.items() if p > 1}
    of = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast("bigint") for p in several.items() for x in p]), F.col("length")), F.lit(1)) if several else F.lit(1)
    made = made.withColumn("part", F.pmod("own", of).cast("int")).drop("own")
    sizes = made.groupBy("length", "part").count().orderBy("length", "part").collect()  # at most capacity + PARTS rows
    counts: dict[int, int] = {}
    before: dict[int, list[int]] = {}
    for r in sizes:
        before.setdefault(r["length"], [0] * parts[r["length"]])[r["part"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["count"]
    ranges = {n: np.array(x, dtype=np.int64) for n, x in plan(counts, capacity).items()}
    bases = {n: np.array(x, dtype=np.int64) for n, x in before.items()}
    sent = docs.sparkSession.sparkContext.broadcast((ranges, bases))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = made.withColumn("rank", F.row_number().over(within) - 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = sent.value
        for b in batches:
            length, part, rank = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "part", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                r = rank[mine] + base[n][part[mine]]
                at = np.searchsorted(where[n][:, 0], r, side="right") - 1
                sequence[mine] = where[n][at, 1] + r - where[n][at, 0]
                offset[mine] = where[n][at, 2]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(placed, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
