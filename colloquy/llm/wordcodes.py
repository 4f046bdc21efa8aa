"""Token ids of whole texts, by looking up pieces between spaces; a piece met for the first time is encoded by the library.

A tokenizer that splits texts before it merges gives a piece the same ids wherever it stands, as long as texts are cut
where it would itself split. Both splits used here cut between a word and the space before the next one. So ids of
pieces are kept, as bytes, and a text's ids are a join of look-ups. The table of kept pieces is bounded; pieces that no
longer fit are encoded again when they come back. Added tokens in a text, such as an end-of-text mark, have their own
ids, as in the library.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: Pieces kept by each table of a Python worker; about 200 bytes each.
KEPT = 450_000
#: Pieces at a line's beginning, which are fewer.
FIRST = 100_000
#: The first code point of a combining mark: texts below it are in NFC, and lower-case code point by code point.
MARKS = 0x300


def _bytes_of_chars() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _ranks(model: dict, suffix: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if merging by least id is merging in the order of its merges; else None.

    The word end is shown as byte FF, which UTF-8 does not have.
    """
    of, end = _bytes_of_chars(), b"\xff"

    def plain(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix) and token != suffix
        return bytes(of[c] for c in (token[: -len(suffix)] if ends else token)) + end * ends

    try:
        ranks = {plain(t): i for t, i in model["vocab"].items() if not (t.startswith("<|") and t.endswith("|>"))}
        merged = [ranks[plain(a) + plain(b)] for a, b in (m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"])]
    except KeyError:
        return None
    single = [i for t, i in ranks.items() if len(t.removesuffix(end) or t) == 1]
    ordered = all(a < b for a, b in zip(merged, merged[1:], strict=False)) and (not merged or max(single) < merged[0])
    return ranks if ordered and len(set(merged)) == len(merged) else None


class _Added:
    """Added tokens of a vocabulary: a text is cut at them before all else, the leftmost and then the longest first.

    That is what the library does for tokens that take no space and part no words; ``plain`` is false for others.
    """

    def __init__(self, tokens: list[dict]):
        self.plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokens)
        self.ids = {t["content"]: _packed([t["id"]]) for t in tokens}
        longest = sorted(self.ids, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else None
        self.probes = sorted({c[:2] for c in longest})

    def within(self, text: str) -> bool:
        return any(p in text for p in self.probes) and any(c in text for c in self.ids)

    def joined(self, text: str, ids: Callable[[str], bytes]) -> bytes:
        return b"".join(self.ids[x] if k % 2 else ids(x) for k, x in enumerate(self.split(text)))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Kept(dict):
    """Ids of pieces; a piece that is not there is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes], most: int = KEPT):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece) if piece else b""
        if len(self) < self.most and len(piece) <= 64:
            self[piece] = out
        return out


class WordCodes:
    """For a word vocabulary: lower-cased, white space dropped, the last byte of a word marked as such."""

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        model, self.added = spec["model"], _Added(spec["added_tokens"])
        suffix = model["end_of_word_suffix"] or ""
        ranks = _ranks(model, suffix) if suffix else None
        self.merge = ranks and tiktoken.Encoding("words", pat_str=r"(?s:.)+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.kept = _Kept(self.piece)

    def piece(self, piece: str) -> bytes:
        if self.merge is None or max(piece) >= chr(MARKS):
            return _packed(self.library.encode(piece, add_special_tokens=False).ids)
        low = piece.lower()
        words = (low,) if low.isalpha() else (low[:-1], low[-1]) if low[-1] in ".," and low[:-1].isalpha() else self.split(low)
        one = self.merge._encode_single_piece
        return _packed([i for w in words for i in one(w.encode() + b"\xff")])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added.within(text):
            return self.added.joined(text, self.between) if self.added.plain else _packed(self.library.encode(text, add_special_tokens=False).ids)
        return self.between(text)

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        return b"".join(map(self.kept.__getitem__, text.replace("\n", " ").split(" ")))


class ByteCodes:
    """For a byte-level vocabulary that keeps white space; a space goes with the word after it."""

    def __init__(self, file: str):
        if file.endswith(".tiktoken"):
            import public_tokenizers

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
            pattern, self.added = public_tokenizers.PATTERN, _Added([])
        else:
            self.library = Tokenizer.from_file(file)
            spec = json.load(open(file, encoding="utf-8"))
            ranks, self.added = _ranks(spec["model"], ""), _Added(spec["added_tokens"])
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merge = ranks and tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)").split
        self.kept = _Kept(self.piece, FIRST)
        self.after_space = _Kept(lambda x: self.piece(" " + x))

    def piece(self, piece: str) -> bytes:
        if self.merge is None:
            return _packed(self.library.encode(piece, add_special_tokens=False).ids)
        return _packed(self.merge.encode_ordinary(piece))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added.within(text):
            return self.added.joined(text, self.between) if self.added.plain else _packed(self.library.encode(text, add_special_tokens=False).ids)
        return self.between(text)

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens.

        The text is cut before each space that a word follows, and around each newline that stands alone between words.
        """
        if text.replace("\n", " ").split(" ") != text.split():  # other white space, or several in a row
            return b"".join(map(self.kept.__getitem__, self.cut(text)))
        out, first, later, newline = [], self.kept, self.after_space.__getitem__, self.kept["\n"]
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(first[words[0]])
            out.extend(map(later, words[1:]))
            out.append(newline)
        return b"".join(out[:-1])


@lru_cache(maxsize=2)
def word_codes(file: str) -> WordCodes:
    return WordCodes(file)


@lru_cache(maxsize=2)
def byte_codes(file: str) -> ByteCodes:
    return ByteCodes(file)
