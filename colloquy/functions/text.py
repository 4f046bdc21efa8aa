"""Text scalars as Column builders: markup, tokens, asserted lines, cues, keys, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cues

#: Shapes that the functions below look for.
LATIN_RUN = r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*"
THAI_RUN = r"[฀-๿]+"
CAMEL_PART = r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"
#: A run of one part, or else, as its group, a run of several.
COMPOUND_RUN = rf"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?![-_./]?[A-Za-z0-9])|({LATIN_RUN})"
TICKET = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]{1,9}-\d{1,6}(?![A-Za-z0-9_])"
EMPTY_ANSWER = r"(?i)^[\s•*\-–—.]*(?:n/?a|none|nope|no|ไม่มี|ยังไม่มี|ok|okay)?[\s.]*$"
BULLET = r"^(?:[\s>]*[•◦‣·\-*+]+\s*|[\s>]*\d+[.)]\s*)"
MENTION = r"<@([UW][A-Z0-9]{6,})>|@([UW][A-Z0-9]{6,})"
PLACEHOLDER = r"(?i)\bx{3,}\b|\[\s*(id|finished|module name|date month year|เรื่องที่รออยู่|@คนที่ต้องทำให้ก่อน[^\]]*|tag[^\]]*)\s*\]"
NOTHING = r"(?i)^(-{1,3}|–|—|\.|none|n/a|na|no|nope|nothing|ไม่มี|ไม่มีครับ|ไม่มีค่ะ|เคลียร์|clear)$"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: what stands in an array of one is a variable in the function."""
    return F.element_at(F.transform(F.array(value), use), 1)


# tokens


def thai_grams(run: Column) -> Column:
    """Overlapping pairs, then triples, of a Thai run; the run itself where it has one character."""
    n = F.length(run)

    def grams(w: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(run, i, F.lit(w)))
        return F.when(n >= w, cut).otherwise(F.array().cast("array<string>"))

    return F.when(n > 1, F.concat(grams(2), grams(3))).otherwise(F.array(run))


def latin_tokens(run: Column) -> Column:
    """An identifier whole, then its parts between separators, then its camel-case parts; all lower-cased."""
    return F.concat(F.array(F.lower(run)), run_parts(run))


def run_parts(run: Column) -> Column:
    none = F.array().cast("array<string>")
    parts = F.when(run.rlike("[-_./]"), F.split(F.lower(run), "[-_./]")).otherwise(none)
    camel = _all(run, CAMEL_PART)
    humps = F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(none)
    return F.concat(parts, humps)


def tokens(text: Column) -> Column:
    """Index terms of a text, repeats included, in order."""
    runs = _all(text, f"{THAI_RUN}|{LATIN_RUN}")
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{THAI_RUN}$"), thai_grams(r)).otherwise(latin_tokens(r))))


def terms(text: Column) -> Column:
    """The same terms in no particular order. Only runs of several parts, and Thai, are looked at one by one."""
    none = F.array().cast("array<string>")
    runs = _all(text, LATIN_RUN)
    whole = F.when(F.size(runs) > 0, F.split(F.lower(F.array_join(runs, " ")), " ")).otherwise(none)
    compound = F.array_remove(_all(text, COMPOUND_RUN, 1), "")
    thai = F.when(text.rlike(THAI_RUN), F.flatten(F.transform(_all(text, THAI_RUN), thai_grams))).otherwise(none)
    return F.concat(whole, F.flatten(F.transform(compound, run_parts)), thai)


def trigrams(text: Column) -> Column:
    """Overlapping runs of three characters of the lower-cased text without white space."""
    squeezed = F.regexp_replace(F.lower(text), r"\s+", "")
    none = F.array().cast("array<string>")
    cut = lambda t: F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))).otherwise(none)
    # what stands in an array of one is squeezed once, and not again for each run
    return F.coalesce(F.element_at(F.transform(F.array(squeezed), cut), 1), none)


# markup

#: Entities that chat exports escape.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def normalize(text: Column) -> Column:
    """Chat markup to plain text: references, mentions, links, emoji codes, white space."""
    t = unescape(text)
    t = F.regexp_replace(t, r"<#[A-Z0-9]+\|([^>]+)>", "#$1")
    t = F.regexp_replace(t, r"<#[A-Z0-9]+\|?>", " ")
    t = F.regexp_replace(t, r"<!subteam\^[A-Z0-9]+\|([^>]+)>", "$1")
    t = F.regexp_replace(t, r"<!subteam\^[A-Z0-9]+\|?>", " ")
    t = F.regexp_replace(t, r"<@[A-Z0-9]+\|\s*([^>]*?[^>\s])\s*>", "@$1")
    t = F.regexp_replace(t, r"<@([A-Z0-9]+)(?:\|\s*)?>", "@$1")
    t = F.regexp_replace(t, r"<!(?:here|channel|everyone)(?:\|[^>]*)?>", " ")
    t = F.regexp_replace(t, r"<(?![@#!])[^>|\s]+\|\s*([^>]*?[^>\s])\s*>", "$1")
    t = F.regexp_replace(t, r"<(?![@#!])(?i:https?://|mailto:|tel:)?([^>|\s]+)(?:\|\s*)?>", "$1")
    t = F.regexp_replace(t, r"(?i):[a-z0-9_+\-]+:(?::skin-tone-\d:)?", " ")
    t = F.regexp_replace(F.replace(t, F.lit("\r"), F.lit("\n")), "[ \t ​‌﻿]+", " ")
    t = F.regexp_replace(t, r"\n{2,}", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?m)^\s+|[ \t]+$", ""), r"^\s+|\s+$", "")


def mentions(text: Column) -> Column:
    """Ids of the people a message addresses, in order, once each."""
    return F.array_distinct(_all(unescape(text), r"<@([A-Z0-9]+)(?:\|[^>]*)?>", 1))


#: Fixed value: what a system message begins with.
SYSTEM = r"(?i)^(?:@[^\n]{1,40}?\s+)?(?:has (?:joined|left) the channel|has renamed the channel|set the channel (?:topic|purpose|description)|(?:un)?pinned a message to this channel|.{0,60}\bmoved some of the messages from this conversation\b|added an integration to this channel|cleared the channel (?:topic|purpose))"
PICTOGRAPHS = r"[\x{1F000}-\x{1FAFF}←-⇿⌀-➿⬀-⯿️‍〰〽]"
SPLIT = r"[\s,.!?~\-_/\\|()\[\]{}<>\"'`“”„…•+*=:;^]+"


def is_noise(token: Column) -> Column:
    """An acknowledgement, or one character again and again."""
    return token.isin(cues.NOISE) | (F.length(F.replace(token, F.substring(token, 1, 1), F.lit(""))) == 0)


def is_useful(text: Column) -> Column:
    """Whether a message says anything: a technical word does, and so does any token that is not noise."""
    technical = rf"(?i)(?<![a-z0-9])(?:{'|'.join(cues.TECHNICAL)})(?![a-z0-9])"
    words = F.filter(F.split(F.lower(F.regexp_replace(text, PICTOGRAPHS, " ")), SPLIT), lambda t: t != "")
    said = text.rlike(technical) | F.exists(words, lambda t: ~is_noise(t))
    return F.coalesce((text != "") & ~text.rlike(SYSTEM) & said, F.lit(False))


# what the author asserts


def asserted_lines(text: Column) -> Column:
    """The author's own lines: without code fences, quoted lines, struck text and inline code; none of them empty."""
    t = F.regexp_replace(text, r"(?s)```.*?(?:```|\z)", " ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:&gt;|>)[ \t]?.*$", " ")
    t = F.regexp_replace(t, r"~([^~\n]{2,})~", " ")
    t = F.regexp_replace(t, r"`[^`\n]+`", " ")
    return F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), collapse), lambda line: line != "")


def analysis(text: Column) -> Column:
    return F.array_join(asserted_lines(text), " ")


def for_analysis(prepared: Column, text: Column) -> Column:
    """The prepared text, even if empty; computed only where there is none."""
    return F.coalesce(prepared, analysis(text))


# cues


def _bounded(cue: str) -> str:
    quoted = "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in cue)
    return rf"(?<![A-Za-z]){quoted}(?![A-Za-z])"


def cue_at(text: Column, cue: str) -> Column:
    """Where a cue begins in lower-cased text, from 0; null if it doesn't occur.

    Cues with Latin letters are bounded by other characters. Thai has no spaces, and no dictionary is at hand: a
    Thai cue counts unless a Thai vowel or mark that must follow a consonant continues its last word.
    """
    return F.nullif(F.regexp_instr(text, F.lit(_pattern(cue))), F.lit(0)) - 1


def _pattern(cue: str) -> str:
    return _bounded(cue) if any("a" <= c <= "z" for c in cue) else rf"{cue}(?![ะ-ฺๅ-๎])"


def has_cue(text: Column, some: list[str]) -> Column:
    """Whether one of the cues occurs."""
    return F.lower(text).rlike("|".join(f"(?:{_pattern(c)})" for c in some))


def first_cue(text: Column, some: list[str], window: int | None = None) -> Column:
    """The first cue, in list order, that occurs (no later than the window); null if none does."""
    low = F.lower(text)
    hits = [F.when(low.rlike(_pattern(c)) if window is None else cue_at(low, c) <= window, F.lit(c)) for c in some]
    return F.when(has_cue(text, some), F.coalesce(*hits))


def is_question(text: Column) -> Column:
    return text.rlike(cues.QUESTION)


# waiting lines


def unbullet(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, BULLET, ""))


def completion_governs(line: Column, waiting: Column) -> Column:
    """Whether a word of completion stands before the waiting cue, with no contrast in between."""
    low = F.lower(line)
    done = F.least(*[F.coalesce(cue_at(low, c), F.lit(1 << 30)) for c in cues.RELATIONS["resolves"][2]])
    wait = F.coalesce(*[F.when(waiting == c, cue_at(low, c)) for c in cues.WAITING])
    between = F.substring(low, done + 1, wait - done)
    turned = F.lit(False)
    for word in cues.CONTRAST:
        turned = turned | F.coalesce(cue_at(between, word) >= 0, F.lit(False))
    return F.coalesce((done < wait) & ~turned, F.lit(False))


def waiting_on(line: Column) -> Column:
    """Ids named on a line, once each."""
    pairs = F.transform(F.arrays_zip(_all(line, MENTION, 1), _all(line, MENTION, 2)), lambda p: F.coalesce(F.nullif(p["0"], F.lit("")), p["1"]))
    return F.array_distinct(pairs)


# keys and names


def ticket_keys(text: Column) -> Column:
    """Ticket keys, upper-cased, once each, in order."""
    return F.array_distinct(F.transform(_all(text, TICKET), F.upper))


def prefix(key: Column) -> Column:
    return F.substring_index(key, "-", 1)


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9฀-๿]+", "-"), F.lit("-"))


def content_id(first_id: Column) -> Column:
    """A short name for an item without a ticket, from the id of its first message."""
    return F.concat(F.lit("c"), F.left(F.sha1(first_id.cast("binary")), F.lit(6)))


def pseudonym(id_: Column, firsts: list[str], lasts: list[str]) -> Column:
    """A stable invented name: two bytes of the id's SHA-1 choose its parts."""
    digest = F.sha1(id_.cast("binary"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (F.conv(F.substring(digest, at, 2), 16, 10).cast("int") % len(names)) + 1)
    return F.concat_ws(" ", pick(firsts, 1), pick(lasts, 3))


def shorten(text: Column, most: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 1)), F.lit("…"))).otherwise(flat)


def embed_text(title: Column, body: Column, most: int = 400) -> Column:
    """A ticket for an encoder: its title and the first two lines of prose, cut to length."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), r"\r\n|[\n\r]"), collapse)
    prose = F.slice(F.filter(lines, lambda x: (F.length(x) >= 15) & ~x.rlike(r"^[#>|!`\[\-*]")), 1, 2)
    whole = F.array_join(F.concat(F.array(collapse(title)), prose), " ")
    return F.when(F.length(whole) > most, F.concat(F.left(whole, F.lit(most)), F.lit("…"))).otherwise(whole)


def normal_blocker(text: Column) -> Column:
    """The comparable form of a waiting line: no mentions, no leading "pending", no marks."""
    t = F.lower(F.regexp_replace(text, r"<@[UW][A-Z0-9]{2,}(?:\|[^>]*)?>", " "))
    t = F.regexp_replace(t, r"^\s*pending(?![a-z0-9_])[:\s]*", " ")
    return collapse(F.regexp_replace(t, "[#*_~`\"'’“”(),.:;!?\\-–—]", " "))
