"""Thai words by a dictionary: a trie, and the shortest path over the lattice of its matches.

Thai is written without spaces, so a run of it is cut where the dictionary's words fit best: with the fewest characters
that no word covers, then in the fewest parts, then with the longest part first. A part doesn't begin with a vowel or mark
that belongs to the consonant before, and doesn't end after a vowel that is written before its consonant. Characters that no
word covers make one part as long as they are in a row. Everything else in a text is parted by its kind.

The word list is a parameter, as large as one pleases that fits a worker: it goes to each once, and texts are cut in Arrow
batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters that belong to the consonant before them, and vowels written before their consonant.
FOLLOWS, LEADS = re.compile(r"[ะ-ฺๅ็-๎]"), re.compile(r"[เ-ไ]")
PARTS = re.compile(r"[฀-๿]+|[A-Za-z]+|[0-9]+|\s+|[^฀-๿A-Za-z0-9\s]+")
_END = ""


class Lattice:
    """Cuts texts into words. Words that are empty, or begin where none may, are of no use and are left out."""

    def __init__(self, words: Iterable[str]) -> None:
        self.trie: dict = {}
        for word in words:
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            if word:
                node[_END] = True
        self.run = lru_cache(maxsize=65_536)(self._run)

    def _run(self, run: str) -> tuple[str, ...]:
        n = len(run)
        edge = [i in (0, n) or not (FOLLOWS.match(run[i]) or LEADS.match(run[i - 1])) for i in range(n + 1)]
        # from each place to the end: (characters no word covers, parts), and the part that begins there
        best: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        step, word_at = [0] * (n + 1), [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            if not edge[i]:
                continue
            k = next(j for j in range(i + 1, n + 1) if edge[j])
            # what no word covers goes on with the same part if that is uncovered too
            best[i] = (best[k][0] + k - i, best[k][1] + (1 if k == n or word_at[k] else 0))
            step[i], word_at[i] = k, False
            node, j = self.trie, i
            while j < n and (node := node.get(run[j])) is not None:
                j += 1
                if _END in node and edge[j]:
                    cost = best[j][0], best[j][1] + 1
                    if cost < best[i] or (cost == best[i] and word_at[i]):
                        best[i], step[i], word_at[i] = cost, j, True
        out: list[str] = []
        i, open_ = 0, False
        while i < n:
            if open_ and not word_at[i]:
                out[-1] += run[i : step[i]]
            else:
                out.append(run[i : step[i]])
            open_ = not word_at[i]
            i = step[i]
        return tuple(out)

    def parts(self, text: str) -> list[tuple[int, str]]:
        """(offset, part) of a whole text, in order."""
        out = []
        for m in PARTS.finditer(text):
            at = m.start()
            for part in self.run(m[0]) if "฀" <= m[0][0] <= "๿" else (m[0],):
                out.append((at, part))
                at += len(part)
        return out

    def find(self, text: str, cues: Iterable[str]) -> list[tuple[str, int]]:
        """(cue, offset) of each cue that stands in a text as a run of whole parts, where it does so first."""
        cut = self.parts(text)
        where: dict[str, list[int]] = {}
        for i, (_, part) in enumerate(cut):
            where.setdefault(part, []).append(i)
        out = []
        for cue in cues:
            needle = [p for _, p in self.parts(cue)]
            for i in where.get(needle[0], []) if needle else []:
                if [p for _, p in cut[i : i + len(needle)]] == needle:
                    out.append((cue, cut[i][0]))
                    break
        return out


def with_words(rows: DataFrame, words: Iterable[str], text: str = "text", into: str = "words") -> DataFrame:
    """rows with the words of a text's Thai runs, in order, repeats included; null texts have none."""
    known = tuple(words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(known)
        for b in batches:
            found = [[p for _, p in lattice.parts(x or "") if "฀" <= p[0] <= "๿"] for x in b.column(text).to_pylist()]
            yield _added(b, into, pa.array(found, pa.list_(pa.string())))

    return rows.drop(into).mapInArrow(cut, _schema(rows, into, "array<string>"))


def with_cues(rows: DataFrame, cues: Iterable[str], words: Iterable[str], text: str = "text", into: str = "cues") -> DataFrame:
    """rows with array<struct<cue, at>>: the cues, in list order, that stand in a text as runs of whole words, lower-cased."""
    known, wanted = tuple(words), tuple(cues)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(known)
        kind = pa.list_(pa.struct([("cue", pa.string()), ("at", pa.int32())]))
        for b in batches:
            hits = [[{"cue": c, "at": i} for c, i in lattice.find((x or "").lower(), wanted)] for x in b.column(text).to_pylist()]
            yield _added(b, into, pa.array(hits, kind))

    return rows.drop(into).mapInArrow(found, _schema(rows, into, "array<struct<cue:string,at:int>>"))


def _schema(rows: DataFrame, into: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != into), f"`{into}` {kind}"])


def _added(b: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, column], names=[*b.schema.names, name])
