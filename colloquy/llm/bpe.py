"""Byte-level BPE by ranks: whole texts to ids and back.

Texts are cut into pieces without a regular expression. Each code point gets a class by table look-up (letter, number,
space, other white space, other), refined by a look ahead of up to two code points: whether white space is followed by
more of it, and whether an apostrophe begins a contraction. What is left is a finite automaton over these symbols. Its
transition functions compose associatively, so the states at all positions come from a scan: the symbols are laid out
in rows, each row's functions are composed column by column for all rows at once, the row functions are scanned by
doubling, and a last sweep from the now known states marks where pieces begin. A reset symbol between texts lets one
scan serve many of them.

Pieces are merged pair by pair in rank order, and what they gave is kept in a bounded table. Decoding gathers the
bytes of all ids at once by their offsets in one string of the whole vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Pieces whose ids each Python worker keeps; about 200 bytes each.
KEPT = 600_000
#: Code points scanned at once.
CHUNK = 1 << 20
#: Rows are this long in the scan.
ROW = 128

# classes of code points
OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
#: The code points of Unicode's White_Space property, but for the space itself.
WHITE_SPACE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# symbols: the classes, seen with what follows
S_RESET, S_OTHER, S_LETTER, S_NUMBER, S_LEAD, S_LAST, S_INNER, S_SHORT, S_LONG = range(9)
# states: what the piece so far is
START, IN_OTHER, IN_LETTERS, IN_NUMBERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode version of the regex library, newer than Python's own."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for code, runs in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            for m in regex.finditer(runs, "".join(map(chr, range(low, high)))):
                out[low + m.start() : low + m.end()] = code
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    return out


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """For symbol and state: the next state, and whether a piece begins."""
    go, begin = np.zeros((9, 8), dtype=np.uint8), np.zeros((9, 8), dtype=bool)
    for state in range(8):
        go[S_RESET, state] = START
        for symbol, own in ((S_OTHER, IN_OTHER), (S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS)):
            go[symbol, state], begin[symbol, state] = own, state not in (own, AFTER_SPACE)
        if state == TWO_LEFT:  # inside a contraction letters go on without a beginning
            go[S_LETTER, state], begin[S_LETTER, state] = ONE_LEFT, False
        elif state == ONE_LEFT:
            go[S_LETTER, state], begin[S_LETTER, state] = START, False
        go[S_LEAD, state], begin[S_LEAD, state] = AFTER_SPACE, True
        go[S_LAST, state], begin[S_LAST, state] = START, True
        go[S_INNER, state], begin[S_INNER, state] = IN_WHITE, state != IN_WHITE
        for symbol, left in ((S_SHORT, ONE_LEFT), (S_LONG, TWO_LEFT)):  # an apostrophe within a run of others stays there
            inside = state in (IN_OTHER, AFTER_SPACE)
            go[symbol, state], begin[symbol, state] = IN_OTHER if inside else left, not inside
    return go, begin


GO, BEGIN = _automaton()


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The symbol of each code point; resets: positions that stand between texts."""
    n = len(points)
    kind = classes()[points]
    edge = np.zeros(n + 2, dtype=bool)
    edge[resets] = True
    edge[n:] = True
    white = kind >= SPACE
    more = np.append(white, False)[1:] | edge[1 : n + 1]  # white space or the text's end follows
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_LEAD, S_LAST], dtype=np.uint8)[kind]
    out[white & more] = S_INNER
    out[resets] = S_RESET
    quote = np.flatnonzero(points == ord("'"))
    quote = quote[~edge[quote]]
    after = np.append(points, [0, 0])
    one, two = after[quote + 1], after[quote + 2]
    is_one, is_two = ~edge[quote + 1], ~edge[quote + 1] & ~edge[np.minimum(quote + 2, n + 1)]
    out[quote[is_one & np.isin(one, [ord(c) for c in "stmd"])]] = S_SHORT
    pairs = np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    out[quote[is_two & pairs]] = S_LONG
    return out


def beginnings(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Positions where pieces begin."""
    n = len(points)
    rows = max(1, -(-n // ROW))
    laid = np.zeros(rows * ROW, dtype=np.uint8)
    laid[:n] = symbols(points, resets)
    laid = np.ascontiguousarray(laid.reshape(rows, ROW).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for column in laid:  # each row's functions, composed from left to right
        whole = GO[column[:, None], whole]
    step = 1
    while step < rows:  # all rows up to each one, by doubling
        before = whole[:-step]
        whole = np.concatenate([whole[:step], np.take_along_axis(whole[step:], before, axis=1)])
        step *= 2
    state = np.append(np.uint8(START), whole[:-1, START]).astype(np.uint8)
    found = np.empty((ROW, rows), dtype=bool)
    for k, column in enumerate(laid):
        found[k] = BEGIN[column, state]
        state = GO[column, state]
    return np.flatnonzero(found.T.reshape(-1)[:n])


class BytePairs:
    """Ranks as tiktoken has them: the rank is the id, and the pair of least rank merges first, the leftmost of equals."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((i, token) for token, i in self.ranks.items())
        size = by_id[-1][0] + 1
        lengths = np.zeros(size, dtype=np.int64)
        lengths[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), dtype=np.uint8)
        self.kept: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 400:
            return self._merged_long(piece)
        parts = [piece[k : k + 1] for k in range(len(piece))]
        never = 1 << 62
        pair = [ranks.get(piece[k : k + 2], never) for k in range(len(piece) - 1)]
        while pair:
            least = min(pair)
            if least == never:
                break
            k = pair.index(least)
            parts[k] += parts.pop(k + 1)
            pair.pop(k)
            if k < len(pair):
                pair[k] = ranks.get(parts[k] + parts[k + 1], never)
            if k:
                pair[k - 1] = ranks.get(parts[k - 1] + parts[k], never)
        return [ranks[p] for p in parts]

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same for long pieces, by a heap of pairs over linked parts, in n log n."""
        from heapq import heapify, heappop, heappush

        ranks, n = self.ranks, len(piece)
        end, after, before = list(range(1, n + 1)), [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
        heapify(heap)
        gone = bytearray(n)

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0 and (r := ranks.get(piece[k : end[after[k]]])) is not None:
                heappush(heap, (r, k, end[after[k]]))

        while heap:
            _, k, stop = heappop(heap)
            if gone[k] or after[k] < 0 or end[after[k]] != stop:
                continue
            right = after[k]
            gone[right], end[k], after[k] = 1, end[right], after[right]
            if after[k] >= 0:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [ranks[piece[k : end[k]]] for k in range(n) if not gone[k]]

    def piece(self, piece: str) -> bytes:
        out = array("I", self.merged(piece.encode("utf-8", "replace"))).tobytes()
        if len(self.kept) < KEPT and len(piece) <= 64:
            self.kept[piece] = out
        return out

    def encode_batch(self, whole: list[str]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit bytes."""
        held: list[list[str]] = []
        size = 0
        for text in whole:
            parts = _cut(text)
            held.append(parts)
            size += len(text)
            if size >= CHUNK:
                yield from self._encode(held)
                held, size = [], 0
        if held:
            yield from self._encode(held)

    def _encode(self, held: list[list[str]]) -> Iterator[bytes]:
        parts = [p for ps in held for p in ps]
        out: list[bytes] = []
        at = 0
        while at < len(parts):  # as many parts as make up a chunk
            stop, size = at, 0
            while stop < len(parts) and (stop == at or size + len(parts[stop]) <= 2 * CHUNK):
                size += len(parts[stop])
                stop += 1
            out.extend(self._scan(parts[at:stop]))
            at = stop
        at = 0
        for ps in held:
            yield out[at] if len(ps) == 1 else b"".join(out[at : at + len(ps)])
            at += len(ps)

    def _scan(self, parts: list[str]) -> list[bytes]:
        big = "\0" + "\0".join(parts) + "\0"
        points = np.frombuffer(big.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        resets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        begin = beginnings(points, resets)
        if not len(begin):
            return [b""] * len(parts)
        end = np.append(begin[1:], len(points))
        first = np.searchsorted(begin, resets)
        stops = np.searchsorted(begin, resets[1:]) - 1
        full = stops >= first[:-1]
        end[stops[full]] = resets[1:][full]
        kept, piece = self.kept, self.piece
        codes = [kept.get(x) or piece(x) for x in [big[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]]
        edges = first.tolist()
        return [b"".join(codes[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, dtype="<u4")
        out = []
        for a in range(0, len(at), CHUNK):
            some = at[a : a + CHUNK]
            n = self.lengths[some]
            ends = np.cumsum(n)
            out.append(self.bytes[np.arange(int(ends[-1])) + np.repeat(self.offsets[some] - (ends - n), n)].tobytes())
        return b"".join(out)


def _cut(text: str) -> list[str]:
    """A text above CHUNK in parts, cut before spaces that a letter follows, where a piece always begins."""
    parts = []
    at = 0
    while len(text) - at > CHUNK:
        cut = at + CHUNK
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text) or text[cut + 1].isalpha():
                break
            cut += 1
        if cut < 0 or cut + 1 >= len(text):
            break
        parts.append(text[at:cut])
        at = cut
    parts.append(text[at:] if at else text)
    return parts


@lru_cache(maxsize=2)
def byte_pairs(file: str) -> BytePairs:
    return BytePairs(file)


def encoded(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids: little-endian unsigned 32-bit bytes) of each whole text. Null texts are empty and have no ids.

    Lone surrogates are replaced by question marks. Rows are independent of each other, so repeated rows and missing
    keys come out as they went in. Other columns are not read.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                some = b.slice(a, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(pairs.encode_batch(texts(some.column(1))), pa.binary())], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(of, f"key {kind}, ids binary")


def round_trip(docs: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text's ids, and the bytes that decoding the ids gives."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(ranks)
        for b in batches:
            ids = b.column("ids").to_pylist()
            back = [hashlib.sha256(pairs.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    made = encoded(docs, ranks)
    kind = made.schema["key"].dataType.simpleString()
    return made.mapInArrow(of, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
