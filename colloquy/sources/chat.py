"""A chat service as a Spark data source: channels and ranges of time are partitions, pages follow cursors, and a stream
goes on in each channel from its newest time.

The service is a callable, named as ``module:name`` in the option ``transport`` and called as
``transport(method, options, **parameters)``; it returns the method's answer as a dict, and raises Limited where the
service asks to wait. ``recorded`` is one that answers from files.
"""

from __future__ import annotations

import json
import time
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib import import_module

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.items import is_chat_id

SCHEMA = "channel string, ts string, thread_ts string, user string, text string, subtype string, bot_id string, is_reply boolean, reactions array<string>, permalink string"
#: Messages of a page at most, and how often a call that must wait is tried.
PAGE, TRIES = 200, 5
#: Seconds that a stream looks back for threads with new replies, seconds of a partition, and partitions of a channel at most.
LOOKBACK, SPAN, RANGES = 7 * 86400.0, 86400.0, 16
#: Bytes of a file of recorded messages that are read at a time.
BLOCK = 1 << 20


class Limited(Exception):
    """The service asks to be called again after some seconds."""

    def __init__(self, after: float = 1.0):
        super().__init__(f"limited; again after {after} s")
        self.after = after


def called(ask: Callable[[], dict], wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer, waiting as long as the service says; after TRIES calls the last refusal is raised."""
    for left in range(TRIES, 0, -1):
        try:
            return ask()
        except Limited as e:
            if left == 1:
                raise
            wait(max(0.0, e.after))
    raise AssertionError


class _Service:
    def __init__(self, options: dict[str, str]):
        module, _, name = options["transport"].partition(":")
        self.options, self.transport = dict(options), getattr(import_module(module), name)

    def pages(self, method: str, key: str, **parameters) -> Iterator[dict]:
        cursor = ""
        while True:
            limit = min(PAGE, int(self.options.get("page", PAGE)))
            answer = called(lambda at=cursor: self.transport(method, self.options, cursor=at, limit=limit, **parameters))
            yield from answer.get(key) or []
            cursor = (answer.get("response_metadata") or {}).get("next_cursor") or ""
            if not cursor:
                return

    def channels(self) -> list[str]:
        """Channels that are asked for, else those that the service is a member of, by name."""
        if named := self.options.get("channels"):
            return [c.strip() for c in named.split(",") if c.strip()]
        found = [(c.get("name") or "", c["id"]) for c in self.pages("conversations.list", "channels") if c.get("is_member")]
        return [c for _, c in sorted(found)]

    def heads(self, channel: str, oldest: str = "", latest: str = "") -> Iterator[dict]:
        return self.pages("conversations.history", "messages", channel=channel, oldest=oldest, **({"latest": latest} if latest else {}))

    def replies(self, channel: str, head: dict) -> Iterator[dict]:
        """The replies to a message, without the message itself that the service repeats."""
        if int(head.get("reply_count") or 0) > 0:
            yield from (r for r in self.pages("conversations.replies", "messages", channel=channel, ts=head["ts"]) if r.get("ts") != head["ts"])

    def row(self, channel: str, m: dict, reply: bool) -> Iterator[tuple]:
        """A message's row, if it is wanted: not one's own; with the option subtypes only those, and only what has a text."""
        own, kinds = self.options.get("own", ""), self.options.get("subtypes")
        if own and m.get("user") == own:
            return
        if kinds is not None and (not m.get("text") or (m.get("subtype") and m["subtype"] not in kinds.split(","))):
            return
        link = m.get("permalink")
        if link is None and not reply and self.options.get("permalinks", "").lower() == "true":
            link = called(lambda: self.transport("chat.getPermalink", self.options, channel=channel, ts=m["ts"])).get("permalink")
        yield channel, m.get("ts"), m.get("thread_ts"), m.get("user"), m.get("text"), m.get("subtype"), m.get("bot_id"), reply, [r.get("name") for r in m.get("reactions") or []], link

    def messages(self, channel: str, oldest: str = "") -> Iterator[tuple]:
        """A channel's messages, each followed by its replies; what isn't wanted comes without its thread."""
        most = int(self.options.get("limit", 1 << 62))
        for m in self.heads(channel, oldest):
            if most <= 0:
                return
            most -= 1
            for row in self.row(channel, m, False):
                yield row
                for r in self.replies(channel, m):
                    yield from self.row(channel, r, True)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in _Service(self.options).channels()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _Service(self.options).messages(partition.value, self.options.get("oldest", ""))


@dataclass
class _Range(InputPartition):
    """Heads of a channel from low on, up to high (with it, if last); of their threads what is from since to end."""

    channel: str
    low: float
    high: float
    last: bool
    since: str
    end: str


class _Stream(DataSourceStreamReader):
    """From the newest time of each channel; its rows come again, so that what shares it isn't lost.

    An offset is a time for each channel. A batch's messages are read by tasks, one for each channel and range of time:
    the newest RANGES - 1 spans, and what is older. Replies to messages of up to ``lookback`` seconds before the offset
    are found as they come; a reply later than that is not. The driver only asks for the newest time of each channel,
    for which it turns the pages of messages from ``lookback`` seconds ago on and keeps none. A batch that is run again
    asks for the same ranges. Replies are told from heads by their own time, so none comes before its batch.
    """

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.lookback, self.span = float(options.get("lookback", LOOKBACK)), float(options.get("span", SPAN))
        self.known: dict[str, str] = {}

    def initialOffset(self) -> dict:
        return {}

    def _newest(self, service: _Service, channel: str) -> str | None:
        head = next(service.heads(channel), None)
        if head is None:
            return None
        low = max(float(self.options.get("oldest", "0")), float(head["ts"]) - self.lookback)
        times = (t for m in service.heads(channel, repr(low)) for t in (m["ts"], m.get("latest_reply")) if t)
        return max(times, key=float, default=None)

    def latestOffset(self) -> dict:
        service = _Service(self.options)
        found = {c: self._newest(service, c) for c in service.channels()}
        for c, t in found.items():  # a channel never goes back, not even when its newest message was deleted
            if t is not None and float(t) >= float(self.known.get(c, "-inf")):
                self.known[c] = t
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = {**start, **end}
        return [r for c in sorted(end) if end[c] != start.get(c) for r in self._ranges(c, start.get(c), end[c])]

    def _ranges(self, channel: str, start: str | None, end: str) -> Iterator[_Range]:
        oldest, high = float(self.options.get("oldest", "0")), float(end)
        since = self.options.get("oldest", "0") if start is None else start
        low = oldest if start is None else max(oldest, float(start) - self.lookback)
        last = True
        for _ in range(RANGES - 1):
            if high - self.span <= low:
                break
            yield _Range(channel, high - self.span, high, last, since, end)
            high, last = high - self.span, False
        yield _Range(channel, low, high, last, since, end)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        service, p = _Service(self.options), partition
        since, end = float(p.since), float(p.end)
        for m in service.heads(p.channel, repr(p.low), repr(p.high)):
            at = float(m["ts"])
            if not (p.low <= at < p.high or (p.last and at == p.high)):
                continue
            rows = list(service.row(p.channel, m, False))
            if not rows:
                continue
            if at >= since:
                yield from rows
            elif m.get("latest_reply") and float(m["latest_reply"]) < since:
                continue
            for r in service.replies(p.channel, m):
                if since <= float(r["ts"]) <= end:
                    yield from service.row(p.channel, r, True)


class Chat(DataSource):
    """format("chat") with the options transport, channels, oldest, page, limit, own, subtypes, permalinks; streams: lookback, span."""

    @classmethod
    def name(cls) -> str:
        return "chat"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


@dataclass
class _Places:
    """Where the lines of a channel's messages lie, without their texts: lines in order of time, heads, and replies by thread."""

    times: np.ndarray  # of heads
    heads: np.ndarray  # a head's line
    replies: np.ndarray  # a reply's line, by thread and time
    threads: np.ndarray  # its thread
    ts: np.ndarray  # of each line, as it is written
    place: np.ndarray  # (file, begin, length) of each line
    files: tuple[tuple[str, int, int], ...]

    def message(self, path: str, line: int) -> dict:
        file, begin, length = self.place[line].tolist()
        blocks = range(begin // BLOCK, (begin + length - 1) // BLOCK + 1)
        text = b"".join(_block(path, self.files[file], i) for i in blocks)
        return json.loads(text[begin - blocks[0] * BLOCK :][:length])

    def thread(self, ts: str) -> np.ndarray:
        low, high = (np.searchsorted(self.threads, ts.encode(), side) for side in ("left", "right"))
        return self.replies[low:high]

    def head(self, path: str, line: int) -> dict:
        """A head with what is known of its thread."""
        m = self.message(path, line)
        said = self.thread(m["ts"])
        return m | {"reply_count": len(said), "latest_reply": self.ts[said[-1]].decode()} if len(said) else m

    def head_of(self, ts: str) -> np.ndarray:
        """The last head of that time, if there is one."""
        low, high = (np.searchsorted(self.times, float(ts), side) for side in ("left", "right"))
        some = self.heads[low:high]
        return some[self.ts[some] == ts.encode()][-1:]


@lru_cache(maxsize=32)
def _block(path: str, file: tuple[str, int, int], number: int) -> bytes:
    """A piece of a file. A few are held, as messages of a page and their threads lie close together."""
    with _store(path)[0].open_input_file(file[0]) as f:
        f.seek(number * BLOCK)
        return f.read(BLOCK)


def _lines(store: fs.FileSystem, name: str) -> Iterator[tuple[int, bytes]]:
    """(begin, line) of a file, read in pieces."""
    with store.open_input_stream(name) as f:
        at, rest, more = 0, b"", True
        while more:
            piece = f.read(BLOCK)
            more = bool(piece)
            *whole, rest = (rest + piece).split(b"\n") if more else (rest, b"")
            for line in whole:
                for part in line.splitlines(keepends=True):
                    yield at, part
                    at += len(part)
                at += 1


@lru_cache(maxsize=2)
def _kept(path: str, files: tuple[tuple[str, int, int], ...]) -> _Places:
    """A channel's places. Those of the last two channels that were asked for are held: some tens of bytes for a message, however long."""
    store, parts = _store(path)[0], []
    for i, (name, _, _) in enumerate(files):
        ts, thread, place = [], [], []
        for begin, line in _lines(store, name):
            if line.strip():
                m = json.loads(line)
                ts.append(m["ts"].encode())
                thread.append(m["ts"].encode() if m.get("thread_ts") is None else m["thread_ts"].encode())
                place.append((i, begin, len(line)))
        parts.append((np.array(ts, dtype="S"), np.array(thread, dtype="S"), np.array(place, dtype=np.int64).reshape(-1, 3)))
    if not parts:
        parts = [(np.empty(0, "S1"), np.empty(0, "S1"), np.empty((0, 3), np.int64))]
    ts, thread, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = ts.astype(np.float64)
    order = np.argsort(at, kind="stable")
    own = ts == thread
    heads, replies = order[own[order]], order[~own[order]]
    replies = replies[np.argsort(thread[replies], kind="stable")]
    return _Places(at[heads], heads, replies, thread[replies], ts, place, files)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop path or a plain one, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def recorded(method: str, options: dict[str, str], channel: str = "", ts: str = "", oldest: str = "", latest: str = "", cursor: str = "", limit: int = PAGE) -> dict:
    """Answers from JSON lines in the folder of the option path, one folder channel=ID for each channel, newest first.

    The path may be in any file system that Arrow opens by its scheme, as a cluster's shared folders are.
    """
    store, path = _store(options["path"])
    if method == "conversations.list":
        found = sorted(i.base_name.split("=", 1)[1] for i in store.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("channel="))
        return {"channels": [{"id": c, "name": c, "is_member": True} for c in found]}
    if method == "chat.getPermalink":
        return {"permalink": f"{options['path']}/channel={channel}#{ts}"}
    files = store.get_file_info(fs.FileSelector(f"{path}/channel={channel}", allow_not_found=True))
    known = _kept(options["path"], tuple(sorted((i.path, i.size, i.mtime_ns or 0) for i in files if i.base_name.endswith(".json"))))
    at = int(cursor or 0)
    if method == "conversations.replies":
        head, said = known.head_of(ts), known.thread(ts)
        lines, n = np.r_[head, said], len(head) + len(said)
        some = [known.head(options["path"], i) if i in head else known.message(options["path"], i) for i in lines[at : at + limit]]
    else:
        low, high = bisect_left(known.times, float(oldest or 0)), bisect_right(known.times, float(latest or "inf"))
        n = max(0, high - low)
        some = [known.head(options["path"], i) for i in known.heads[max(low, high - at - limit) : max(low, high - at)][::-1]]
    return {"messages": some, "response_metadata": {"next_cursor": str(at + limit) if at + limit < n else ""}}


# names


def names(spark: SparkSession, path: str) -> DataFrame:
    """(user, name) of a JSON object of names by id."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("user", "name"))


def best_names(members: DataFrame) -> DataFrame:
    """(user, name): the shown name, else the real one, else the handle; bots are marked. Members without any are left out.

    members(id, name, real_name, is_bot, profile: struct with display_name and real_name).
    """
    some = [F.nullif(F.trim(c), F.lit("")) for c in ("profile.display_name", "profile.real_name", "real_name", "name")]
    bot = F.coalesce("is_bot", F.lit(False)) | (F.col("id") == "USLACKBOT")
    return members.select(F.col("id").alias("user"), F.coalesce(*some).alias("name"), bot.alias("bot")).where("name is not null").select("user", F.when(F.col("bot"), F.concat("name", F.lit(" (bot)"))).otherwise(F.col("name")).alias("name"))


def ids_of_corpus(records: DataFrame) -> DataFrame:
    """(user, n): how often each id of the chat appears as a record's user."""
    user = F.trim("user")
    return records.where(is_chat_id(user)).groupBy(user.alias("user")).agg(F.count(F.lit(1)).alias("n"))


def names_in_text(records: DataFrame, known: DataFrame, unknown=None) -> DataFrame:
    """Records (id, text) whose mentions of ids are names; an id without one stays, or is what unknown(id column) makes of it.

    Only mentions are touched: an id in prose may be quoted.
    """
    shape = r"@([UWB][A-Z0-9]{7,})\b"
    cut = records.select("id", F.split("text", shape).alias("parts"), F.regexp_extract_all("text", F.lit(shape), F.lit(1)).alias("ids"))
    asked = cut.select("id", F.explode(F.array_distinct("ids")).alias("user")).join(known.select("user", "name"), "user", "left")
    other = unknown(F.col("user")) if unknown else F.col("user")
    maps = asked.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("user", F.coalesce("name", other)))).alias("names"))
    said = F.zip_with("parts", F.transform("ids", lambda u: F.concat(F.lit("@"), F.col("names")[u])), lambda p, n: F.concat(p, F.coalesce(n, F.lit(""))))
    return cut.join(maps, "id", "left").select("id", F.array_join(said, "").alias("text"))
