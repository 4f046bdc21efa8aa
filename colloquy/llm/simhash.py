"""SimHash near-duplicates.

Fingerprints of word shingles are compared exactly, in tiles, with numpy's exclusive-or and bit counts. A tile is
named by the population counts of the fingerprint's bytes. Flipping one bit moves one of these counts by one, so two
fingerprints within the radius have tile names at most that far apart, and tile pairs further apart are never made:
each fingerprint is dealt to its own tile and to those at most half the radius away, where any two that may be linked
meet. Within a tile rows are ordered by total population count and a comparison stops where that differs beyond the
radius. In tiles above ``tile_rows`` all rows are first compared with one of them, the pivot. Rows near it are linked by
that; the others, and they alone, are compared with all rows, chunk by chunk, each pair of chunks a task's work. So a
large group of near copies costs no more than its rows.

A tile's links leave it as a forest, never as all pairs, and components() joins these up.

Where the radius is too wide for population counts to tell tiles apart (``deal="minima"``), the tiles are named by the
least shingle hash in each of ``bands`` equal parts of the hash range: documents of Jaccard similarity J share one of
them with probability 1 - (1 - J)^bands. The comparison in a tile stays the same.

With ``alike``, repeated shingles count once, and links of fingerprints are only candidates: within each group of them
two texts link if their sets of shingles have at least that Jaccard similarity, which is computed in full. Large groups
are treated as large tiles are: first all with one text, then what isn't linked by that with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, runs, stored, texts
from .components import components

SEED = 42


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words, if fewer; none for no words.

    Words are what stands between the bytes 20 and 09 to 0D; A to Z are lower-cased.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(x) + 1 for x in found])
    starts = [0, *(ends[:-words]).tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=len(starts))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a hash."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(hashes: np.ndarray, words: int = 1) -> list[int]:
    """So many 64-bit words; a bit is 1 if it is set in over half of the hashes. No hashes: zero."""
    out = []
    for k in range(words):
        h, ones = _mixed(hashes, k), np.zeros(64, dtype=np.int64)
        for a in range(0, len(h), 1 << 16):  # bounds the memory of a very long text
            bits = np.unpackbits(h[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 128 * 128
            ones += bits[:whole].reshape(-1, 128, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, bands: int = 0, key: str = "doc_id", text: str = "text", once: bool = False) -> DataFrame:
    """(key, words: array of 64-bit words as longs, minima: array of tile names if bands are asked for).

    once: repeated shingles count once, and there is a column th, a hash of the text.
    """
    also = ["th"] * once

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, least = [], []
            for t in texts(b.column("text")):
                h = shingle_hashes(t, shingle)
                h = np.unique(h) if once else h
                prints.append(np.array(fingerprint(h, words), dtype=np.uint64).view(np.int64).tolist())
                least.append(_minima(h, bands))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in ["key", *also]], pa.array(prints, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], ["key", *also, "words", "minima"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), *[F.xxhash64(text).alias("th")] * once, F.col(text).alias("text")).mapInArrow(of, f"key {kind}, {'th bigint, ' * once}words array<bigint>, minima array<bigint>")


def _minima(h: np.ndarray, bands: int) -> list[int]:
    if not bands or not len(h):
        return [0] * min(bands, 1)
    band = (h >> np.uint64(32)) * np.uint64(bands) >> np.uint64(32)
    least = np.full(bands, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, band.astype(np.int64), _mixed(h, 77))
    return np.unique(_mixed(least[np.unique(band.astype(np.int64))], 5).view(np.int64)).tolist()


def _around(words: int, reach: int) -> list[tuple[int, ...]]:
    """Changes of the bytes' population counts by at most reach in all, as (byte, sign) steps."""
    steps = [s * (k + 1) for k in range(8 * words) for s in (1, -1)]
    out: set[tuple[int, ...]] = set()
    for n in range(reach + 1):
        for some in combinations_with_replacement(steps, n):
            if not {-x for x in some} & set(some):
                out.add(some)
    return sorted(out)


def tiles_by_population(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (n, words): (row, tile name) of each row's own tile and those within reach."""
    n, w = words.shape
    counts = np.bitwise_count(words.astype("<u8").view(np.uint8).reshape(n, 8 * w)).astype(np.int16)
    rows, names = [], []
    weights = _mixed(np.arange(1, 8 * w + 1, dtype=np.uint64), 11) if w > 1 else np.uint64(16) ** np.arange(8, dtype=np.uint64)
    for change in _around(w, reach):
        moved = counts.copy()
        for x in change:
            moved[:, abs(x) - 1] += 1 if x > 0 else -1
        able = ((moved >= 0) & (moved <= 8)).all(axis=1)
        rows.append(np.flatnonzero(able))
        names.append((moved[able].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64))
    return np.concatenate(rows), np.concatenate(names).view(np.int64)


def _forest(words: np.ndarray, node: np.ndarray, group: np.ndarray, radius: int, sure: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least linked node) between rows of a group whose fingerprints differ in at most radius bits.

    sure: says of two rows' places whether they link indeed; asked only of rows that no links connect yet.
    """
    pop = np.bitwise_count(words).sum(axis=1, dtype=np.int32)
    order = np.lexsort((node, pop, group))
    words, node, group, pop = words[order], node[order], group[order], pop[order]
    n = len(node)
    label = np.arange(n)
    bounds = runs(group)
    end = np.repeat(bounds[1:], np.diff(bounds))
    here, d = np.arange(n), 1
    while True:
        there = here + d
        here = here[there < end[here]]
        here = here[pop[here + d] - pop[here] <= radius]  # ordered by count: no later row can come back within it
        if not len(here):
            break
        there = here + d
        differ = np.zeros(len(here), dtype=np.int32)
        for column in words.T:
            differ += np.bitwise_count(column[here] ^ column[there])
        near = np.flatnonzero(differ <= radius)
        a, b = here[near], there[near]
        if sure:
            near = [k for k in np.flatnonzero(label[a] != label[b]).tolist() if sure(order[a[k]], order[b[k]])]
            a, b = a[near], b[near]
        while len(a):
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            if not len(a):
                break
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
        d += 1
    linked = np.flatnonzero(label != np.arange(n))
    return node[linked], node[label[linked]]


def _cells(rows: DataFrame, group: str, chunk_rows: int) -> DataFrame:
    """rows(group, node, open, ...) with i, j: cells in which all pairs of a group meet of which one at least is open.

    Rows that aren't open are connected already; groups without open rows have no cells.
    """
    chunks = lambda c: F.ceil(F.count_if(c) / chunk_rows).cast("int")
    counts = durable(rows.groupBy(group).agg(chunks(F.col("open")).alias("of_open"), chunks(~F.col("open")).alias("of_rest")).where("of_open > 0"))
    known = rows.join(_small(counts), group)
    at = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    mine = F.when(F.col("open"), at("of_open")).otherwise(F.col("of_open") + at("of_rest"))
    others = F.sequence(F.lit(0), F.col("of_open") - 1 + F.when(F.col("open"), F.col("of_rest")).otherwise(0))
    cut = known.withColumn("mine", mine).withColumn("other", F.explode(others))
    return cut.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("mine", "other", "of_open", "of_rest")


def _small(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Durable rows, to be broadcast only if they are few."""
    return F.broadcast(rows) if rows.count() <= most else rows


def links(prints: DataFrame, w: int = 1, radius: int = 2, deal: str = "population", tile_rows: int = 2048) -> DataFrame:
    """prints(node long, words, minima), one row for each distinct fingerprint -> (u, v): a forest of its links.

    w: words of a fingerprint.
    """
    if deal == "population":
        reach = (radius + 1) // 2

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for big in batches:
                for a in range(0, big.num_rows, 2000):
                    b = big.slice(a, 2000)
                    words = np.array(b.column("words").to_pylist(), dtype=np.int64).view(np.uint64).reshape(b.num_rows, -1)
                    row, name = tiles_by_population(words, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(name), b.column("node").take(pa.array(row)), b.column("words").take(pa.array(row))], ["tile", "node", "words"])

        entries = prints.select("node", "words").mapInArrow(dealt, "tile bigint, node bigint, words array<bigint>")
    else:
        entries = prints.select(F.explode("minima").alias("tile"), "node", "words")
    sizes = entries.groupBy("tile").count().where(F.col("count") > tile_rows)
    large = durable(sizes.select("tile"))
    star, once = None, entries
    if large.limit(1).count():
        tiles = _small(large)
        big = entries.join(tiles, "tile")
        pivots = durable(big.groupBy("tile").agg(F.min_by(F.struct("node", "words"), "node").alias("p")).select("tile", F.col("p.node").alias("pivot"), F.col("p.words").alias("pivot_words")))
        bits = F.zip_with("words", "pivot_words", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        big = durable(big.join(_small(pivots), "tile").withColumn("open", F.aggregate(bits, F.lit(0), lambda n, x: n + x) > radius).drop("pivot_words"))
        star = big.where("not open and node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        cells = _cells(big.drop("pivot"), "tile", tile_rows).select("tile", "i", "j", "node", "words")
        once = entries.join(tiles, "tile", "left_anti")
    cut = once.select("tile", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "words")
    cut = (cut.unionByName(cells) if star is not None else cut).select("tile", "i", "j", "node", *[F.col("words")[k].alias(f"w{k}") for k in range(w)])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        names = ["tile", "i", "j", "node", *[f"w{k}" for k in range(w)]]

        def done(cols: list[np.ndarray]) -> pa.RecordBatch:
            at = runs(*cols[:3])
            size = np.diff(at)
            group = np.repeat(np.arange(len(size)), size)
            keep = np.repeat(size > 1, size)
            words = np.stack([c.view(np.uint64) for c in cols[4:]], axis=1)
            u, v = _forest(words[keep], cols[3][keep], group[keep], radius)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for b in batches:
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in names]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = runs(*cols[:3])[-2] if len(cols[0]) else 0  # its group may go on in the next batch
            rest = [c[last:].copy() for c in cols]
            if last:
                yield done([c[:last] for c in cols])
        if rest is not None and len(rest[0]):
            yield done(rest)

    found = cut.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(compared, "u bigint, v bigint")
    return found if star is None else found.unionByName(star)


def _similar(x: np.ndarray, y: np.ndarray, alike: float) -> bool:
    """Whether two sets have at least that Jaccard similarity."""
    if min(len(x), len(y)) < alike * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= alike * (len(x) + len(y) - shared)


def confirmed(named: DataFrame, docs: DataFrame, shingle: int, w: int, radius: int, alike: float, text: str = "text", group_rows: int = 256) -> DataFrame:
    """named(root, node, words, th) -> (u, v): a forest of the links within each root that a comparison of the texts confirms.

    In groups above group_rows all texts are first compared with the root's, in parts; those that aren't linked by that
    are then compared with all, chunk by chunk.
    """
    named = durable(named)
    sizes = durable(named.groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    some = durable(named.join(sizes, "root"))
    source = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    # copies of a text are put together before they are shuffled; an inner join, as a semi-join would be moved below that
    read = stored(source.dropDuplicates(["th"]).join(some.select("th").distinct(), "th"), "candidates")

    def sets(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple]:
        """Rows of sorted groups with their sets of shingles."""
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                columns = [part.column(k).to_pylist() for k in keys]
                for row, t in zip(zip(*columns, strict=True), texts(part.column("text")), strict=True):
                    yield (*row, np.unique(shingle_hashes(t, shingle)))

    def forest(u: list[int], v: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = None
        found: list[tuple[int, int]] = []
        for root, part, node, mine in sets(batches, "root", "part", "node"):
            if (root, part) != now:  # the root's row comes first in each part
                now, first = (root, part), mine
            elif _similar(first, mine, alike):
                found.append((node, root))
            if len(found) >= 4096:
                yield forest(*map(list, zip(*found, strict=True)))
                found = []
        if found:
            yield forest(*map(list, zip(*found, strict=True)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            node = np.array([r[0] for r in rows], dtype=np.int64)
            prints = np.array([r[1] for r in rows], dtype=np.int64).view(np.uint64).reshape(len(rows), w)
            u, v = _forest(prints, node, np.zeros(len(rows), dtype=np.int64), radius, lambda a, b: _similar(rows[a][2], rows[b][2], alike))
            return forest(u.tolist(), v.tolist())

        now, rows = None, []
        for root, i, j, node, prints, mine in sets(batches, "root", "i", "j", "node", "words"):
            if (root, i, j) != now:
                if len(rows) > 1:
                    yield done(rows)
                now, rows = (root, i, j), []
            rows.append((node, prints, mine))
        if len(rows) > 1:
            yield done(rows)

    kind = "u bigint, v bigint"
    cut = some.where(F.col("rows") <= group_rows).select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "words", "th")
    star = None
    if sizes.where(F.col("rows") > group_rows).limit(1).count():
        large = some.where(F.col("rows") > group_rows)
        parts = F.ceil(F.col("rows") / (16 * group_rows)).cast("int")
        every = F.explode(F.when(F.col("node") == F.col("root"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))))
        dealt = large.withColumn("part", every).select("root", "part", (F.col("node") != F.col("root")).alias("later"), "node", "th").join(read, "th")
        star = durable(dealt.repartition("root", "part").sortWithinPartitions("root", "part", "later").mapInArrow(starred, kind))
        linked = star.select(F.col("u").alias("node"), F.lit(False).alias("open"))
        rest = large.join(linked, "node", "left").withColumn("open", F.coalesce("open", F.col("node") != F.col("root")))
        cut = cut.unionByName(_cells(durable(rest), "root", group_rows).select("root", "i", "j", "node", "words", "th"))
    found = cut.join(read, "th").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "node", "words", "text").mapInArrow(compared, kind)
    return found if star is None else found.unionByName(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 2, deal: str = "population", bands: int = 0, key: str = "doc_id", text: str = "text", alike: float = 0.0, tile_rows: int = 2048, group_rows: int = 256) -> DataFrame:
    """(key, words, component_id): each row's fingerprint and the least key of the rows reachable by links.

    Rows link if their fingerprints differ in at most ``radius`` bits and, where ``alike`` is given, their distinct
    shingles have at least that Jaccard similarity. Null and empty texts have fingerprint zero and
    link like any other; equal fingerprints always link; rows with a null key take part, and have the component of
    their fingerprint, whose least key ignores nulls. Further columns of docs play no part. Repeated rows are repeated
    in the result. An empty table gives an empty one.
    """
    prints = durable(fingerprints(docs, shingle, words, bands, key, text, once=alike > 0))
    distinct = prints.groupBy("words").agg(F.min("key").alias("least"), *[F.min("th").alias("th")] * (alike > 0), *[F.min("minima").alias("minima")] * (deal != "population"))
    distinct = durable(distinct.withColumn("node", F.monotonically_increasing_id()))
    found = components(links(distinct, words, radius, deal, tile_rows))
    if alike:
        found = components(confirmed(distinct.join(found, "node").select("root", "node", "words", "th"), docs, shingle, words, radius, alike, text, group_rows))
    named = distinct.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = durable(named.groupBy("root").agg(F.min("least").alias("component_id")))  # a plain shuffle below: a large group's join can be split
    of = durable(named.join(least, "root").select("words", "component_id"))
    return prints.join(of, "words").select("key", "words", "component_id")


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """docs without all but the least doc_id of each group of near-duplicates; columns as they were.

    Of rows that repeat the least doc_id all stay, and rows without a doc_id stay.
    """
    groups = near_duplicates(docs, **how)
    gone = groups.where(F.col("key") != F.col("component_id")).select(F.col("key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__key"], "left_anti")
