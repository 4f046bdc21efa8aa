"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters, digits and underscores, and runs of other marks. Features are hashed to 2^BITS places:
lower-cased words, pairs of them, and triples of word shapes (case, digits, marks and length, without the letters). A
text is a sparse vector of their counts over the root of their number; its score is the logistic function of the dot
product with the weights, plus a bias. Long texts are folded in parts, so memory does not grow with them.

Training reads at most ``most`` labelled rows: those with the least hash of their doc_id, a documented sample. It runs
in one task, whose input has that bound. Scoring reads the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

BITS = 18
#: Most labelled rows that training reads.
MOST = 12_000
#: Passes over them.
EPOCHS = 3
#: Learning rate and its smoothing, and the two penalties of the updates.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.2
#: A document is kept from this score on.
KEEP = 0.7
#: Characters of a text that are folded at once.
PART = 1 << 20
#: Words kept with their codes by each Python worker.
KEPT = 200_000

WORDS = re.compile(r"\w+|[^\w\s]+").findall
#: Where a text can be cut without cutting a word.
BETWEEN = re.compile(r"\b|(?=\s)|(?<=\s)").search


class _Codes(dict):
    """A word's hash and shape as one number; kept while there is room."""

    def __missing__(self, word: str) -> int:
        shape = 0 if word[0].isalnum() or word[0] == "_" else 1
        shape = 2 * shape + word.isupper()
        shape = 2 * shape + any(map(str.isdigit, word))
        shape = 8 * shape + min(7, len(word).bit_length())
        if not word[0].isalnum():
            shape += 64 * (1 + zlib.crc32(word[:3].encode("utf-8", "replace")) % 61)
        out = (shape << 32) | zlib.crc32(word.lower().encode("utf-8", "replace"))
        if len(self) < KEPT and len(word) <= 64:
            self[word] = out
        return out


_codes = _Codes()


def _hashed(*parts: np.ndarray) -> np.ndarray:
    x = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for p in parts:
        x = (x ^ p) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> Iterator[np.ndarray]:
    """Places of the features of a text, repeats included, part by part. A text without words has none.

    Parts end between words, and pairs and triples go on from one part to the next.
    """
    a, tail = 0, np.empty(0, dtype=np.uint64)
    while a < len(text):
        cut = BETWEEN(text, a + PART) if a + PART < len(text) else None
        b = cut.start() if cut else len(text)
        words = WORDS(text[a:b] if a or b < len(text) else text)
        a, k = b, len(tail)
        if not words:
            continue
        code = np.concatenate([tail, np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))])
        tail = code[-2:]
        word, shape = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
        again = (word[:-1] == word[1:]).astype(np.uint64)
        pairs, triples = _hashed(word[:-1], word[1:]), _hashed(shape[:-2], shape[1:-1], shape[2:], again[1:])
        yield np.concatenate([_hashed(word[k:]), pairs[max(0, k - 1) :], triples[max(0, k - 2) :]])


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [np.unique(p, return_counts=True) for p in features(text)]
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    if len(found) == 1:
        at, n = found[0]
    else:
        at, back = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([c for _, c in found]))
    return at.astype(np.int32), (n / np.sqrt(n.sum())).astype(np.float32)


def dot(text: str, weights: np.ndarray) -> float:
    total, n = 0.0, 0
    for places in features(text):
        total += float(weights[places].sum(dtype=np.float64))
        n += len(places)
    return total / np.sqrt(n) if n else 0.0


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """rows of (places, values, label) -> weights, the bias last."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in rows:
            now = weight(z[at], n[at])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(now @ x + bias, -35, 35)))
            g = (p - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * now
            n[at] = more
            gb = p - y
            bias_z += gb - (np.sqrt(bias_n + gb * gb) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += gb * gb
    w = weight(z, n)
    return np.append(w, -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST) -> np.ndarray | None:
    """Weights from at most ``most`` labelled rows that are not held out; None if there is none.

    Rows without a doc_id or label are no labels; of several labels for a document the least counts; of repeated
    documents each counts.
    """
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label is not null")
    chosen = chosen.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.min("__label").alias("__label"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(most)
    read = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))  # at most ``most`` rows are broadcast

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                some = b.slice(a, 256)
                found = [_counted(t) for t in texts(some.column(1))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([x.tobytes() for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["doc_id", "label", "places", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sparse = read.select("doc_id", "text", "__label").mapInArrow(counted, f"doc_id {kind}, label int, places binary, values binary")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32), r["label"]) for b in batches for r in b.select(["places", "values", "label"]).to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], ["weights"])

    ordered = sparse.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    found = ordered.mapInArrow(fitted, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else None


def scored(docs: DataFrame, weights: np.ndarray | None, column: str = "score") -> DataFrame:
    """docs with the score of each whole text, from 0 to 1; null texts are empty.

    An empty text has the bias's score. Without weights every score is 0.5. A column of docs with the score's name is
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    mine = docs.drop(column)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            out = [0.5] * b.num_rows if w is None else [float(1 / (1 + np.exp(-np.clip(dot(t, w) + float(w[-1]), -35, 35)))) for t in texts(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, column])

    from pyspark.sql.types import DoubleType, StructType

    return mine.mapInArrow(of, StructType([*mine.schema.fields]).add(column, DoubleType()))
