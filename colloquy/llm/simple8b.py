"""Simple-8b word-aligned coding of token ids, and the file format of token datasets.

A 64-bit word holds a selector in its top 4 bits and, in the other 60, as many equally wide ids as the selector says.
Selector 15 is the escape: the word after it holds one id of up to 64 bits. Ids are coded in blocks of BLOCK ids; a
table has the word at which each block begins, so that blocks can be decoded on their own, and each block is decoded
for all words of a selector at once.

A dataset is a Parquet folder with one row for each segment, a run of whole documents: ``file`` and ``segment`` order
the rows, ``start`` is the number of ids before the segment in its file, ``docs`` has each document's id and number of
ids, ``words`` the coded words (little-endian) and ``blocks`` the first word of each block. Spark writes it, so it can
lie in any store, and a task that is lost leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import texts
from .wordcodes import word_codes

BLOCK = 4096
#: Selector: (ids in a word, bits of each). 0 and 1 are runs of zero.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
#: Ids of a segment after which the next document begins a new one.
SEGMENT = 1 << 18

SCHEMA = "file bigint, segment bigint, start bigint, n_ids bigint, docs array<struct<doc_id:bigint,n:bigint>>, words binary, blocks array<bigint>"


_WIDTH = np.array([k.bit_length() for k in range(1 << 16)], dtype=np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    out = _WIDTH[ids & np.uint64(0xFFFF)]
    for up in (16, 32, 48):
        high = ids >> np.uint64(up)
        if not high.any():
            break
        part = _WIDTH[high & np.uint64(0xFFFF)]
        out = np.where(part > 0, part + np.uint8(up), out)
    return out


def _steps(ids: np.ndarray) -> list[int]:
    """For each position the selector that a word beginning there would take."""
    n = len(ids)
    best = np.full(n, ESCAPE, dtype=np.int8)
    widest = {1: _widths(ids)}  # by count: the most bits of so many ids from each position on
    for s, (count, bits) in reversed(list(enumerate(SELECTORS))):
        if count > n:
            break
        if count not in widest:
            k = next(k for k in sorted(widest) if 2 * k >= count)
            widest[count] = np.maximum(widest[k][: n - count + 1], widest[k][count - k : n - k + 1])
        best[: n - count + 1][widest[count] <= bits] = s
    return best.tolist()


def _block(ids: np.ndarray) -> np.ndarray:
    """The words of one block. The last ids, too few to fill a word, are coded two or one at a time."""
    if not len(ids):
        return np.empty(0, dtype=np.uint64)
    sizes = [c for c, _ in SELECTORS] + [1]
    best, at, i, n = _steps(ids), [], 0, len(ids)
    while i < n:
        at.append(i)
        i += sizes[best[i]]
    starts = np.array(at)
    chosen = np.array(best, dtype=np.int64)[starts]
    place = np.arange(len(at)) + np.concatenate([[0], np.cumsum(chosen == ESCAPE)[:-1]])
    words = np.zeros(len(at) + int((chosen == ESCAPE).sum()), dtype=np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[place[mine] + 1] = ids[starts[mine]]
        elif SELECTORS[s][1]:
            count, bits = SELECTORS[s]
            shift = (np.arange(count, dtype=np.uint64) * np.uint64(bits))[None, :]
            words[place[mine]] |= np.bitwise_or.reduce(ids[starts[mine][:, None] + np.arange(count)] << shift, axis=1)
    return words


def encode(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Ids (unsigned, up to 64 bits) -> words, and the word at which each block of BLOCK ids begins."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = [_block(ids[a : a + BLOCK]) for a in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1].tolist()
    return (np.concatenate(blocks) if blocks else np.empty(0, dtype=np.uint64)), starts[: len(blocks)]


def decode(words: np.ndarray) -> np.ndarray:
    """Words of whole blocks -> ids."""
    words = np.asarray(words, dtype=np.uint64)
    top = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (top == ESCAPE).any():  # a word after an escape is not a word of its own, whatever its top bits
        k, n = 0, len(words)
        escapes = np.flatnonzero(top == ESCAPE).tolist()
        for e in escapes:
            if e >= k and e + 1 < n:
                raw[e + 1] = True
                k = e + 2
    head = np.flatnonzero(~raw)
    chosen = top[head]
    sizes = np.array([c for c, _ in SELECTORS] + [1])[chosen]
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    starts = ends - sizes
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[starts[mine]] = words[head[mine] + 1]
        elif SELECTORS[s][1]:
            count, bits = SELECTORS[s]
            shift = (np.arange(count, dtype=np.uint64) * np.uint64(bits))[None, :]
            out[starts[mine][:, None] + np.arange(count)] = (words[head[mine]][:, None] >> shift) & np.uint64((1 << bits) - 1)
    return out


def decode_block(words: np.ndarray, blocks: list[int], k: int) -> np.ndarray:
    """The ids of block k alone."""
    return decode(words[blocks[k] : blocks[k + 1] if k + 1 < len(blocks) else None])


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, partitions: int | None = None) -> None:
    """Write the ids of every whole text (null: empty), each with end_id after it, in ascending doc_id order.

    A missing doc_id comes first. Rows of the same doc_id keep together, in no particular order. Only doc_id and text
    are read, whatever other columns there are. An empty table gives a dataset without segments.
    """
    session = docs.sparkSession
    n = partitions or max(int(session.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, file = word_codes(vocabulary), TaskContext.get().partitionId()
        tail = np.array([end_id], dtype="<u4").tobytes()
        segment = start = held = 0
        ids: list[bytes] = []
        sizes: list[dict] = []

        def full() -> pa.RecordBatch:
            words, blocks = encode(np.frombuffer(b"".join(ids), dtype="<u4"))
            row = {"file": file, "segment": segment, "start": start, "n_ids": held, "docs": sizes, "words": words.astype("<u8").tobytes(), "blocks": blocks}
            return pa.RecordBatch.from_pylist([row], schema=_arrow())

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids.append(codes.ids(text) + tail)
                sizes.append({"doc_id": doc_id, "n": len(ids[-1]) // 4})
                held += sizes[-1]["n"]
                if held >= SEGMENT:
                    yield full()
                    segment, start, held, ids, sizes = segment + 1, start + held, 0, [], []
        if ids:
            yield full()

    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(written, SCHEMA).write.parquet(path)


def _arrow() -> pa.Schema:
    doc = pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])
    return pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(doc)), ("words", pa.binary()), ("blocks", pa.list_(pa.int64()))])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit bytes), decoded; start counts the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("n"))  # one row for each file
    before = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                ids = decode(np.frombuffer(row["words"], dtype="<u8")).astype("<u4")
                n = np.array([d["n"] for d in row["docs"]], dtype=np.int64)
                starts = np.cumsum(n) - n
                found = [ids[a : a + m].tobytes() for a, m in zip(starts.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array(starts + row["start"] + row["base"]), pa.array(n), pa.array(found, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return rows.join(F.broadcast(before), "file").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
