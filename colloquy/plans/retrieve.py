"""Ranked search as one plan: a preset says which stages are scored, fused and reranked."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import for_analysis
from ..functions.when import nearness
from ..operators import evaluation, fusion, lexical, signals, sparse, vectors
from ..operators.graphs import written


@dataclass(frozen=True)
class Preset:
    """Weights of the stages; a stage of weight 0 is not in the plan."""

    dense: float = 1.0
    lexical: float = 0.0
    anchors: float = 0.0
    thread: float = 0.0
    time: float = 0.0
    user: float = 0.0
    transform: str = "none"
    csls: int = 0
    jaccard: float = 1.0
    rerank: int = 0

    def stages(self) -> dict[str, float]:
        return {k: w for k in ("dense", "lexical", "anchors", "thread", "time", "user") if (w := getattr(self, k))}


#: The presets.
PRESETS = {
    "dense": Preset(),
    "lexical": Preset(dense=0.0, lexical=1.0),
    "dense-abtt": Preset(transform="abtt"),
    "dense-whiten": Preset(transform="whiten"),
    "dense-csls": Preset(csls=10),
    "hybrid": Preset(lexical=1.0),
    "hybrid-anchors": Preset(lexical=1.0, anchors=0.5),
    "hybrid-jaccard": Preset(lexical=1.0, jaccard=0.7),
    "hybrid-rerank": Preset(lexical=1.0, rerank=50),
    "full": Preset(lexical=1.0, anchors=0.5, rerank=50),
    "related": Preset(lexical=1.0, anchors=0.5, thread=1.5, time=0.7, user=0.2, rerank=50),
}

#: (texts of (query_id, id, query, text)) -> (query_id, id, score): a cross-encoder, where there is one.
Reranker = Callable[[DataFrame], DataFrame]


@dataclass
class Corpus:
    """Records (id, text, ts, thread_ts, user, channel_id) with their vectors (id, v), kept for several presets."""

    records: DataFrame
    vectors: DataFrame | None = None
    links: DataFrame | None = None
    reranker: Reranker | None = None
    #: Whether the same queries come again with other presets: a stage is then scored once and written.
    sweep: bool = False
    _kept: dict = field(default_factory=dict)

    def indexed(self) -> DataFrame:
        """(id, text): what is asserted, with the linked ticket's key where a person linked one."""
        if "text" not in self._kept:
            prepared = F.col("analysis_text") if "analysis_text" in self.records.columns else F.lit(None).cast("string")
            said = for_analysis(prepared, F.coalesce("text", F.lit("")))
            own = self.records.select("id", F.coalesce(F.nullif(said, F.lit("")), "text").alias("text"))
            if self.links is not None:
                keys = self.links.where("key like 'ticket:%'").select("id", F.substring("key", 8, 1 << 20).alias("k"))
                own = own.join(keys, "id", "left").select("id", F.concat_ws(" ", "text", "k").alias("text"))
            self._kept["text"] = own
        return self._kept["text"]

    def space(self, preset: Preset) -> DataFrame:
        name = f"space-{preset.transform}"
        if name not in self._kept:
            v = self.vectors
            if preset.transform != "none":
                v = vectors.transformed(v, *vectors.fit(v, preset.transform, vector="v"), key="id", vector="v")
            self._kept[name] = written(v)
        return self._kept[name]


def _sides(corpus: Corpus, queries: DataFrame, preset: Preset) -> tuple[DataFrame, DataFrame]:
    """(id, v) of every record and (query_id, q) of every query, zeros where there is no vector."""
    space = corpus.space(preset)
    width = space.agg(F.max(F.size("v"))).first()[0] or 1
    zero = F.array_repeat(F.lit(0.0), width)
    whole = corpus.records.select("id").join(space, "id", "left").withColumn("v", F.coalesce(F.col("v").cast("array<double>"), zero))
    return whole, queries.select("query_id", F.coalesce(F.col("q").cast("array<double>"), zero).alias("q"))


def dense(corpus: Corpus, queries: DataFrame, preset: Preset, best: int | None = None) -> DataFrame:
    """(query_id, id, score) of every record, or of each query's best ones; a record or a query without a vector scores 0."""
    whole, asked = _sides(corpus, queries, preset)
    if preset.csls:
        whole = vectors.with_hubness(whole, vectors.knn(corpus.space(preset), preset.csls, "id", "v"), key="id")
    found = vectors.cosine_to(whole, asked, "id", "v", best=best, less="hub" if preset.csls else None)
    return found.withColumn("score", F.coalesce("score", F.lit(0.0)))


def _product_stage(weight: float, records: DataFrame, asked: DataFrame) -> fusion.Stage:
    """A stage whose scores are products of sparse rows, above zero."""
    return fusion.Stage(
        weight,
        lambda q, m: sparse.best(records, asked.join(q, "query_id", "left_semi"), m, least=0.0, beyond=True),
        lambda pairs: sparse.products(records, asked, pairs),
        lambda q, scores: sparse.better(records, asked.join(q, "query_id", "left_semi"), scores),
    )


def _pair_stage(weight: float, found: DataFrame) -> fusion.Stage:
    """A stage with few records for a query: (query_id, id, score), above zero; others come after these, also after such as are zero to nine places."""
    best = found.where("score > 0").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    found = written(best.withColumn("rank", fusion.competition_rank(F.col("score"), "query_id")))
    counts = written(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("query_id").orderBy("rank", "id")

    def exact(pairs: DataFrame) -> DataFrame:
        told = pairs.join(found, ["query_id", "id"], "left").join(counts, "query_id", "left")
        return told.select("query_id", "id", F.coalesce("rank", F.coalesce("n", F.lit(0)) + 1).alias("rank"))

    return fusion.Stage(weight, lambda q, m: found.join(q, "query_id", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= m), exact=exact)


def _class_stage(weight: float, records: DataFrame, queries: DataFrame, key: str) -> fusion.Stage:
    """A stage in which all records with the query's key score 1, however many they are; of very many none is sent, as one tells no more than another."""
    kinds = written(records.where(F.col(key) != "").select("id", key))
    sizes = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    asked = written(queries.where(F.col(key) != "").select("query_id", F.col(key)).join(sizes, key).select("query_id", F.col(key).alias("own"), "size"))

    def head(q: DataFrame, m: int) -> DataFrame:
        some = asked.where(F.col("size") <= m).join(q, "query_id", "left_semi")
        return some.join(kinds, F.col("own") == F.col(key)).select("query_id", "id", F.lit(1.0).alias("score"))

    def exact(pairs: DataFrame) -> DataFrame:
        told = pairs.join(asked, "query_id", "left").join(kinds, "id", "left")
        return told.select("query_id", "id", F.when(F.col(key) == F.col("own"), F.lit(1)).otherwise(F.coalesce("size", F.lit(0)) + 1).alias("rank"))

    return fusion.Stage(weight, head, exact=exact)


def best_fused(corpus: Corpus, queries: DataFrame, preset: Preset, k: int) -> DataFrame:
    """(query_id, id, score): the k best of fused(), without a row for each scored pair."""
    stages = []
    for stage, weight in preset.stages().items():
        if stage == "dense":
            whole, asked = (written(df) for df in _sides(corpus, queries, preset))
            named = lambda pairs, a=asked, w=whole: pairs.join(a, "query_id").join(w, "id")
            stages.append(
                fusion.Stage(
                    weight,
                    lambda q, m, a=asked, w=whole: vectors.cosine_to(w, a.join(q, "query_id", "left_semi"), "id", "v", best=m),
                    lambda pairs, named=named: named(pairs).select("query_id", "id", vectors.dot(F.col("q"), F.col("v")).alias("score")),
                    lambda q, scores, a=asked, w=whole: vectors.better(w, a.join(q, "query_id", "left_semi"), scores, "id", "v", itself=True),
                )
            )
        elif stage == "lexical":
            stages.append(_product_stage(weight, *lexical.rows(corpus.indexed(), queries.select("query_id", "text"), key="id")))
        elif stage == "anchors":
            table = written(signals.anchor_table(corpus.indexed()))
            asked = queries.select("query_id", F.explode(signals.anchors(F.col("text"))).alias("anchor"))
            weighted = written(signals.anchor_shares(signals.anchor_idf(table, corpus.records.count()), asked))
            own = table.join(weighted.select("anchor").distinct(), "anchor", "left_semi").withColumn("x", F.lit(1.0))
            records = sparse.rows_of(own, "id", "anchor", "x").withColumn("factor", F.lit(1.0))
            stages.append(_product_stage(weight, written(records), written(sparse.rows_of(weighted, "query_id", "anchor", "share"))))
        elif stage in ("thread", "user"):
            key = {"thread": "thread_ts", "user": "user"}[stage]
            stages.append(_class_stage(weight, corpus.records, queries, key))
        else:
            stages.append(_pair_stage(weight, _near_in_time(corpus, queries)))
    return fusion.reciprocal_best(stages, queries, k, corpus.records.count(), 128 if len(stages) < 4 else 256)


def _near_in_time(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): nearness in time ends at 48 hours, so two records meet in bins of that width."""
    width = 48 * 3600
    asked = queries.select("query_id", F.col("ts").alias("q_ts"), F.explode(F.array(*[F.floor(F.col("ts") / width) + k for k in (-1, 0, 1)])).alias("bin"))
    return corpus.records.select("id", "ts", F.floor(F.col("ts") / width).alias("bin")).join(asked, "bin").select("query_id", "id", nearness(F.col("ts"), F.col("q_ts")).alias("score"))


def scored(corpus: Corpus, queries: DataFrame, preset: Preset) -> DataFrame:
    """(query_id, id, stage, score): of the dense stage for every record, of others only what is above zero.

    A stated query set is compared with all vectors in blocks; all other stages find their records by equal keys.
    queries(query_id, text, q) and, for structural stages, the anchor record's id, ts, thread_ts and user.
    """
    out = []
    for stage in preset.stages():
        name = f"scores-{stage}" + (f"-{preset.transform}-{preset.csls}" if stage == "dense" else "")
        if name in corpus._kept:
            out.append(corpus._kept[name])
            continue
        if stage == "dense":
            found = dense(corpus, queries, preset)
        elif stage == "lexical":
            docs = corpus.indexed()
            found = lexical.scores(lexical.matches(docs, queries.select("query_id", "text"), key="id")).withColumnRenamed("doc_id", "id")
        elif stage == "anchors":
            table = signals.anchor_table(corpus.indexed())
            idfs = signals.anchor_idf(table, corpus.records.count())
            asked = queries.select("query_id", F.explode(signals.anchors(F.col("text"))).alias("anchor"))
            found = signals.anchor_overlap(table, idfs, asked)
        elif stage in ("thread", "user"):
            key = {"thread": "thread_ts", "user": "user"}[stage]
            found = queries.where(F.col(key) != "").select("query_id", key).join(corpus.records.select("id", key), key).withColumn("score", F.lit(1.0))
        else:
            found = _near_in_time(corpus, queries)
        found = found.select("query_id", "id", F.lit(stage).alias("stage"), "score")
        found = found if stage == "dense" else found.where("score > 0")
        out.append(written(found) if corpus.sweep else found)
        if corpus.sweep:
            corpus._kept[name] = out[-1]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def fused(stages: DataFrame, queries: DataFrame, preset: Preset) -> DataFrame:
    """(query_id, id, score, base): reciprocal ranks over all stages; base is the score of a record that no stage scored.

    What a stage did not score ties at 0, and its rank is one more than the number of records that were scored.
    """
    weights = preset.stages()
    ranks = written(stages.withColumn("rank", fusion.competition_rank(F.col("score"), "query_id", "stage")))
    counts = ranks.groupBy("query_id").pivot("stage", list(weights)).agg(F.count(F.lit(1)))
    last = queries.select("query_id").join(counts, "query_id", "left")
    missing = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), w / (fusion.DAMPING + 1 + F.coalesce(F.col(k), F.lit(0))))])
    base = last.select("query_id", missing.alias("missing")).withColumn("base", F.aggregate(F.map_values("missing"), F.lit(0.0), lambda s, x: s + x))
    share = F.create_map(*[F.lit(x) for item in weights.items() for x in item])[F.col("stage")] / (fusion.DAMPING + F.col("rank"))
    both = ranks.withColumn("share", share).join(base, "query_id")
    return both.groupBy("query_id", "id").agg((F.first("base") + F.sum(F.col("share") - F.col("missing")[F.col("stage")])).alias("score"), F.first("base").alias("base"))


def filled(found: DataFrame, corpus: Corpus, queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Rankings with fewer than k records, filled up with the least ids that no stage scored. base(query_id, base)."""
    short = queries.select("query_id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < k).select("query_id")
    least = corpus.records.select("id").orderBy("id").limit(2 * k)  # at most k of them are in a ranking that is short
    more = short.join(F.broadcast(least), F.lit(True)).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").join(base, "query_id", "left")
    return found.select("query_id", "id", "score").unionByName(more.select("query_id", "id", F.coalesce("base", F.lit(0.0)).alias("score")))


def ranked(corpus: Corpus, queries: DataFrame, preset: Preset | str = "hybrid", k: int = 10) -> DataFrame:
    """(query_id, id, rank, score): fused by reciprocal ranks, reranked as the preset says; ties to the smaller id."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    if preset.stages().keys() == {"dense"} and not corpus.sweep:  # of one list only the head counts, and below a reranked one the next
        found = written(dense(corpus, queries, preset, max(k, preset.rerank, 20 if preset.jaccard < 1.0 else 0) + 1))
        base = queries.select("query_id", F.lit(0.0).alias("base"))
    elif preset.stages().keys() == {"lexical"} and not corpus.sweep:
        best = lexical.best(corpus.indexed(), queries.select("query_id", "text"), max(k, preset.rerank, 20 if preset.jaccard < 1.0 else 0) + 1, key="id")
        found, base = written(best.select("query_id", F.col("doc_id").alias("id"), "score")), queries.select("query_id", F.lit(0.0).alias("base"))
    elif preset.dense and len(preset.stages()) > 1 and not preset.csls and not corpus.sweep:
        found = written(best_fused(corpus, queries, preset, max(k, preset.rerank, 20 if preset.jaccard < 1.0 else 0) + 1))
        base = None
    elif len(preset.stages()) == 1:
        stages = scored(corpus, queries, preset)
        found, base = written(stages.select("query_id", "id", "score")), queries.select("query_id", F.lit(0.0).alias("base"))
    else:
        found = written(fused(scored(corpus, queries, preset), queries, preset))
        base = found.select("query_id", "base").distinct()
    if not preset.dense:
        found = filled(found, corpus, queries, base, max(k, preset.rerank))
    found = found.select("query_id", "id", "score")
    if preset.jaccard < 1.0:
        found = fusion.neighbourhood_rerank(found, vectors.knn(corpus.space(preset), 10, "id", "v"), blend=preset.jaccard)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    if preset.rerank and corpus.reranker:
        head = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= preset.rerank)
        texts = head.join(corpus.indexed(), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        found = fusion.spliced(found, corpus.reranker(texts.select("query_id", "id", "query", "text")))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "rank", "score")


def related(corpus: Corpus, ids: DataFrame, k: int = 10, preset: str = "related") -> DataFrame:
    """What goes with given records (id): each is the query, and not in its own result."""
    own = corpus.records.join(ids, "id", "left_semi")
    asked = own.select(F.col("id").alias("query_id"), "text", "ts", "thread_ts", "user").join(corpus.vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id", "left")
    chosen = PRESETS[preset]
    if corpus.vectors is None:
        chosen = replace(chosen, dense=0.0)
    found = ranked(corpus, asked, chosen, k + 1).where("query_id != id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relevance(corpus: Corpus, queries: DataFrame) -> DataFrame:
    """(query_id, lexical, dense): the best absolute scores, whatever a preset fuses; 0 in an empty corpus."""
    lex = lexical.best(corpus.indexed(), queries.select("query_id", "text"), 1, key="id").select("query_id", F.col("score").alias("lexical"))
    out = queries.select("query_id").join(lex, "query_id", "left")
    if corpus.vectors is not None:
        dense = vectors.cosine_to(corpus.vectors, queries.select("query_id", "q"), "id", "v", best=1).groupBy("query_id").agg(F.max("score").alias("dense"))
        out = out.join(dense, "query_id", "left")
    else:
        out = out.withColumn("dense", F.lit(0.0))
    return out.fillna(0.0, ["lexical", "dense"])


def gated(found: DataFrame, known: DataFrame, least: float = 0.45) -> DataFrame:
    """Rankings of queries that the gate lets through: a lexical hit, and a dense score of at least 0.45."""
    return found.join(known.where((F.col("lexical") > 0) & (F.col("dense") >= least)).select("query_id"), "query_id", "left_semi")


def swept(corpus: Corpus, queries: DataFrame, truth: DataFrame, presets: list[str], depth: int = 50) -> DataFrame:
    """(preset, recall, ceiling, ndcg, mrr, map, worst): each preset's measures over one corpus.

    Vectors, spaces and the scores of each stage are made once; presets only fuse them with other weights.
    """
    corpus = replace(corpus, sweep=True, _kept=dict(corpus._kept))
    out = None
    for name in presets:
        ranks = ranked(corpus, queries, name, depth).where("query_id != id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        row = evaluation.summary(evaluation.measures(ranks.select("query_id", "id", "rank"), truth)).withColumn("preset", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
