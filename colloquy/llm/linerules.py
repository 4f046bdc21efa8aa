"""Quality rules by line, in DataFrame expressions alone.

Each line with a word is judged by itself. It fails as navigation if separators part it into short entries, as
boilerplate if it holds a stock phrase of pages, and by its punctuation if words carry runs of symbols or shout, or if it
is long and no word of it ends in a mark that ends a sentence. Failing lines are removed; a document that loses more than a share of
its characters is rejected. Before that come measures of the whole text: too few words, or too many within repeated
runs of words, reject it at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .winnowing import _let as let
from .winnowing import _rolled as rolled

#: Words are runs of what is none of these.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
NO_SYMBOLS = r"[^#*$%&|<>]+"
#: Words of a window whose repetition counts, words that a document has at least, and percent of words in repeated windows at most.
RUN, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Percent of its characters that a document may lose with failing lines.
MOST_LOST = 30
#: A line of so many words has a mark that ends a sentence; fewer make a heading or an entry of a list.
SENTENCE_WORDS = 10
#: Separators of a navigation line, how many it has at least, and words between two of them at most.
SEPARATORS, LEAST_SEPARATORS, ENTRY_WORDS = r"[|»›•·]|(?<=[\x20\x09])[>/](?=[\x20\x09])", 2, 4
#: Percent of a line's words that may end in a run of symbols, or be in capitals with a mark of exclamation.
MOST_MARKED = 20
MARKED = r"(?:[#*$%&|<>~^=_]{2,}+|!{2,}+)(?![^\x20\x09-\x0D])"
ENDS = r"""[.!?…。！？:;][\])}"'”’»*_]*(?:[\x20\x09-\x0D]|$)|[。！？]"""
#: Stock phrases of web pages, in lower case.
BOILERPLATE = ("lorem ipsum", "javascript", "use of cookies", "uses cookies", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "read more", "sign up", "log in", "subscribe to")


def repeated_words(words: Column) -> Column:
    """Words within windows of RUN words that the text has twice or more, the first time included."""

    def covered(h: Column) -> Column:
        def starts(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        begin = F.struct(F.lit(-RUN).alias("at"), F.lit(0).alias("n"))
        total = F.aggregate(let(keyed, starts), begin, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(RUN), x - a["at"])).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(total)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > RUN, let(let(hashes, lambda h: rolled(h, RUN, F.xxhash64)), covered)).otherwise(0)


def measured(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longs, of a text that isn't null."""
    words = F.array_remove(F.split(text, SPACES), "")
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), repeated_words(w).alias("repeated")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    again = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    long = lambda c, name: c.cast("bigint").alias(name)
    return let(
        of_words,
        lambda w: F.struct(
            long(w["n"], "n_words"),
            long(w["chars"], "word_chars"),
            long(F.length(F.regexp_replace(text, NO_SYMBOLS, "")), "n_symbols"),
            long(again, "n_dup_lines"),
            long(w["repeated"], "n_repeat_words"),
        ),
    )


def fails(line: Column) -> Column:
    """Why a line with a word fails: 'navigation', 'boilerplate' or 'punctuation'; null if it doesn't."""
    n_words = F.size(F.split(F.trim(line), SPACES))
    entries = F.regexp_count(line, F.lit(SEPARATORS))
    navigation = (entries >= LEAST_SEPARATORS) & (n_words <= (entries + 1) * (ENTRY_WORDS + 1))
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate |= low.contains(phrase)
    marked = F.regexp_count(line, F.lit(MARKED)) * 100 > MOST_MARKED * n_words
    unended = (n_words >= SENTENCE_WORDS) & ~line.rlike(ENDS)
    return F.when(navigation, "navigation").when(boilerplate, "boilerplate").when(marked | unended, "punctuation")


def _count(lines: Column, reason: str) -> Column:
    return F.size(F.filter(lines, lambda x: x["why"] == reason))


def judged(docs: DataFrame, most_lost: int = MOST_LOST) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text and lost.

    clean_text: the lines that don't fail, with blank lines as they were; lost: a reason and the number of lines, for
    each reason. A document is kept if it has LEAST_WORDS words, no more than MOST_REPEATED percent of them within
    repeated windows, and loses no more than ``most_lost`` percent of the characters of its words. Null texts have no
    words, so they and empty texts are not kept. Rows that repeat are judged alike; rows and other columns stay, and of
    columns with the names above the new ones win. An empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    made = ["measures", "lines"]
    own = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "lost", *made)
    why = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.when(x.rlike(WORD), fails(x)).alias("why")))

    def cleaned(lines: Column) -> Column:
        kept = F.array_join(F.transform(F.filter(lines, lambda x: x["why"].isNull()), lambda x: x["line"]), "\n")
        lost = [_count(lines, reason).alias(reason) for reason in ("navigation", "boilerplate", "punctuation")]
        failing = F.array_join(F.transform(F.filter(lines, lambda x: x["why"].isNotNull()), lambda x: x["line"]), "")
        return F.struct(kept.alias("text"), F.struct(*lost).alias("lost"), F.length(F.regexp_replace(failing, SPACES, "")).alias("chars"))

    both = own.withColumn("measures", measured(text)).withColumn("lines", let(why, cleaned))
    m = F.col("measures")
    base = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    enough = 100 * F.col("lines.chars") <= most_lost * m["word_chars"]
    return both.select(*own.columns, "measures.*", base.alias("base_failed"), (~base & enough).alias("kept"), F.col("lines.text").alias("clean_text"), F.col("lines.lost").alias("lost"))
