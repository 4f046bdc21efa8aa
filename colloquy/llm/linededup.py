"""Line dedup by a log-template tree, in DataFrame expressions alone.

Each line is parsed to a fixed depth: tokens with a digit become a wild card, then the number of tokens and the first
DEPTH tokens lead to a leaf. The rest of the line fills up to SLOTS slots, each an equal share of the tokens in order
(one token each in short lines). Within a leaf a slot's value is constant if lines of at least ``documents`` texts have
it there, and a variable field otherwise. A line's template is its leaf with its constant slots; it counts only if at
least half of the slots are constant. A template recurs if lines of at least ``documents`` different texts have it, and
so does any line that as many texts have but for digits, a line of LONG tokens that two texts have word for word, and a
line of fewer than LEAST_TOKENS that SHORT_DOCUMENTS have. Tokens are cut as in winnowing: characters of scripts
written without spaces stand alone. Blank lines are never dropped.

All lines of recurring templates are dropped, whatever their share. Texts that are equal count once, and so do groups of
near copies: texts that recurring lines make up at least half of, and whose runs of five tokens have Jaccard similarity
ALIKE or more, directly or through others. So copies don't make each other's lines recur, but lines that stand in other
documents too are dropped from copies as from any text. Which values of a slot are constant is told before, from texts as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, stored
from .components import components
from .winnowing import NO_ID, TOKEN, grams

#: Leading tokens of the path to a leaf, and slots for the rest of a line.
DEPTH, SLOTS = 3, 8
#: Different texts that make a template recur.
DOCUMENTS = 3
#: A line of so many tokens recurs from LONG_DOCUMENTS different texts on, if they have it word for word.
LONG, LONG_DOCUMENTS = 20, 2
#: Lines of fewer tokens repeat by chance, and have no template: they recur from so many texts on, word for word.
LEAST_TOKENS, SHORT_DOCUMENTS = 3, 10
#: Only with such characters can a line have tokens of one character that no space parts.
UNSPACED = r"[\u0E00-\x{10FFFF}]"
#: Similarity of near copies. Candidates share one of BANDS / ROWS keys, each of the least hashes in ROWS bands.
ALIKE, BANDS, ROWS = 0.8, 64, 4


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))).withColumn("__th", F.xxhash64("text"))


def parsed(docs: DataFrame) -> DataFrame:
    """(id, th, pos, line, leaf, slots, exact, least, size, whole) for each line with tokens; slots without tokens are null.

    Lines of fewer than LEAST_TOKENS have no leaf and no slots. size, whole: bytes of the line and of its text.

    exact: the line word for word, where it recurs from ``least`` texts on; null for other lines.
    """
    lines = _keyed(docs.select("doc_id", "text")).select(F.col("__id").alias("id"), F.col("__th").alias("th"), F.octet_length("text").alias("whole"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    tokens = F.when(F.col("line").rlike(UNSPACED), F.regexp_extract_all("line", F.lit(TOKEN), F.lit(0))).otherwise(F.regexp_extract_all("line", F.lit(r"\S+"), F.lit(0)))
    cut = lines.where(F.col("line").rlike(r"\S")).select("id", "th", "pos", F.octet_length("line").alias("size"), "whole", tokens.alias("tokens"))  # a filter by tokens would cut them twice
    cut = cut.withColumn("least", F.when(F.size("tokens") >= LONG, LONG_DOCUMENTS).when(F.size("tokens") < LEAST_TOKENS, SHORT_DOCUMENTS)).withColumn("exact", F.when(F.col("least").isNotNull(), F.xxhash64("tokens")))
    cut = cut.withColumn("tokens", F.transform("tokens", lambda t: F.when(t.rlike("[0-9]"), "<*>").otherwise(t)))
    rest = F.greatest(F.size("tokens") - DEPTH, F.lit(0))

    def slot(s: int) -> Column:
        begin, end = F.floor(rest * s / SLOTS).cast("int"), F.floor(rest * (s + 1) / SLOTS).cast("int")
        return F.when(end > begin, F.xxhash64(F.slice("tokens", begin + DEPTH + 1, end - begin)))

    leaf = F.when(F.size("tokens") >= LEAST_TOKENS, F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH)))
    return cut.select("id", "th", "pos", F.xxhash64("tokens").alias("line"), leaf.alias("leaf"), F.array(*[slot(s) for s in range(SLOTS)]).alias("slots"), "exact", "least", "size", "whole")


def recurring(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(line, template): the lines that belong to a recurring template; template is null for such as recur only word for word."""
    texts = lines.where("leaf is not null").select("line", "leaf", "slots", "th").distinct()
    each = texts.groupBy("line", "leaf", "slots").agg(F.count(F.lit(1)).alias("n"), F.min("th").alias("a"), F.max("th").alias("b"))
    busy = each.groupBy("leaf").agg(F.sum("n").alias("of_leaf")).where(F.col("of_leaf") >= documents)  # at least its texts
    known = durable(each.join(durable(busy).hint("shuffle_merge"), "leaf", "left_semi"))
    exact = known.where(F.col("n") >= documents).select("line")
    of = _some_texts(known, texts, documents)
    filled = known.select("leaf", "line", F.size(F.filter("slots", lambda x: x.isNotNull())).alias("of"), F.posexplode("slots").alias("slot", "value")).where("value is not null")
    often = known.select("line", "leaf", F.posexplode("slots").alias("slot", "value")).where("value is not null").join(of, "line")
    often = often.select("leaf", "slot", "value", "th").distinct().groupBy("leaf", "slot", "value").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= documents).drop("times")
    often = durable(often)  # read as a plain shuffle below, so that a join on a very common value can be split
    constant = filled.join(often, ["leaf", "slot", "value"], "left_semi")
    templates = constant.groupBy("leaf", "line", "of").agg(F.count(F.lit(1)).alias("constants"), F.bit_xor(F.xxhash64("slot", "value")).alias("template"))
    templates = durable(templates.where(F.col("constants") * 2 >= F.col("of")).select("leaf", "template", "line"))
    common = templates.join(of, "line").select("leaf", "template", "th").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= documents)
    general = templates.join(common, ["leaf", "template"], "left_semi").select("line", F.xxhash64("leaf", "template").alias("template"))
    both = exact.withColumn("template", F.lit(None).cast("bigint")).unionByName(general)
    return durable(both.groupBy("line").agg(F.max("template").alias("template")))


def _some_texts(known: DataFrame, texts: DataFrame, documents: int) -> DataFrame:
    """(line, th): all texts of a line that fewer than ``documents`` have, and as many stand-ins for those of others.

    Whether the lines of a set stand in at least ``documents`` different texts can be told from these.
    """
    few = F.when(F.col("n") >= documents, F.sequence(F.lit(1), F.lit(documents)).cast("array<bigint>")).when(F.col("n") <= 2, F.array_distinct(F.array("a", "b")))
    some = known.select("line", F.explode(few).alias("th"))
    if documents > 3:
        some = some.unionByName(texts.select("line", "th").join(known.where(F.col("n").between(3, documents - 1)).select("line"), "line", "left_semi"))
    return durable(some)


def recurring_exactly(lines: DataFrame) -> DataFrame:
    """(exact): the lines that enough texts have word for word."""
    texts = lines.where("exact is not null").select("exact", "least", "th").distinct().groupBy("exact", "least").agg(F.count(F.lit(1)).alias("n"))
    return durable(texts.where("n >= least").select("exact"))


def near_copies(texts: DataFrame) -> DataFrame:
    """texts(th, text), th unique -> (th, first): pairs with a similarity of at least ALIKE.

    Each is compared, exactly, with the first of those that share a key with it, so a large group costs no more than its
    rows. Two texts of similarity 0.8 share no key with probability 2e-4.
    """
    sets = durable(texts.select("th", F.array_distinct(grams(F.col("text"))).alias("grams")))
    each = sets.select("th", F.explode("grams").alias("gram"))
    least = each.groupBy("th", F.pmod("gram", F.lit(BANDS)).alias("band")).agg(F.min("gram").alias("least"))
    keys = least.groupBy("th", F.floor(F.col("band") / ROWS).alias("of")).agg(F.xxhash64("of", F.sort_array(F.collect_list("least"))).alias("key"))
    keys = durable(keys.select("th", "key"))
    first = durable(keys.groupBy("key").agg(F.min("th").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    pairs = durable(keys.join(first, "key").where("th != first").select("th", "first").distinct())
    both = pairs.join(sets, "th").join(sets.select(F.col("th").alias("first"), F.col("grams").alias("others")), "first")
    shared = F.size(F.array_intersect("grams", "others"))
    return both.where(shared >= ALIKE * (F.size("grams") + F.size("others") - shared)).select("th", "first")


def _grouped(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(th, group): the near copies among texts that hits, their recurring lines, make up at least half of."""
    each = hits.groupBy("th", "pos").agg(F.max("size").alias("size"), F.max("whole").alias("whole"))
    mostly = durable(each.groupBy("th").agg((F.sum("size") * 2 >= F.max("whole")).alias("mostly")).where("mostly").select("th"))
    texts = _keyed(docs.select("doc_id", "text")).select(F.col("__th").alias("th"), "text").join(mostly.hint("shuffle_hash"), "th", "left_semi")  # texts needn't be sorted
    pairs = near_copies(texts.dropDuplicates(["th"]))
    return components(pairs.select(F.col("th").alias("u"), F.col("first").alias("v"))).select(F.col("node").alias("th"), F.col("root").alias("group"))


def _again(hits: DataFrame, groups: DataFrame, documents: int) -> DataFrame:
    """The hits that still recur if each group of near copies counts as one text."""
    told = hits.join(durable(groups).hint("shuffle_merge"), "th", "left").withColumn("of", F.coalesce("group", "th")).drop("group")
    told = stored(told, "hits")
    kinds = [("line", F.lit(documents)), ("template", F.lit(documents)), ("exact", F.col("least"))]
    keys = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("key"), n.cast("int").alias("least")) for i, (k, n) in enumerate(kinds)])
    each = told.select("id", "th", "pos", "of", F.explode(keys).alias("x")).where("x.key is not null").select("id", "th", "pos", "of", "x.*")
    often = each.select("kind", "key", "of", "least").distinct().groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least"))
    often = durable(often.where("n >= least").select("kind", "key"))
    return each.join(often.hint("shuffle_merge"), ["kind", "key"], "left_semi").select("id", "th", "pos")


def dropped(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """docs with recurring lines dropped from text, and __lines, __dropped: a row's lines, and how many of them went.

    Rows and other columns stay as they were. Null and empty texts have no lines to drop. Rows without a doc_id, and
    repeated rows, are treated like others. An empty table gives an empty one.
    """
    lines = stored(parsed(docs), "lines")
    whole = ["id", "th", "pos", "size", "whole"]
    general = lines.where("leaf is not null").select(*whole, "line").join(recurring(lines, documents), "line").select(*whole, "line", "template")
    exactly = lines.where("exact is not null").select(*whole, "exact", "least").join(recurring_exactly(lines), "exact", "left_semi")
    hits = stored(general.unionByName(exactly, allowMissingColumns=True), "hits")
    found = _again(hits, _grouped(docs, hits), documents)
    gone = found.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("pos").alias("__gone"))
    both = _keyed(docs).join(gone.hint("shuffle_hash"), ["__id", "__th"], "left")
    all_lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("__gone")), lambda k: F.get(F.col("__all"), k))
    cut = both.withColumn("__all", F.when(F.col("__gone").isNotNull(), all_lines)).withColumn("__kept", F.when(F.col("__gone").isNotNull(), F.array_join(kept, "\n")))
    cut = cut.withColumn("__lines", F.when(F.length("text") > 0, F.size(all_lines)).otherwise(0).cast("bigint")).withColumn("__dropped", F.when(F.col("__gone").isNotNull(), F.size("__gone")).otherwise(0).cast("bigint"))
    return cut.withColumn("text", F.coalesce("__kept", "text")).select(*docs.columns, "__lines", "__dropped")


def without_recurring_lines(docs: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """docs without recurring lines, columns as they were; n_chars, if there, follows the text."""
    out = dropped(docs, documents)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
