"""Retrieval: exact kNN, BM25 inside a candidate set, blends, fusion, reranking, budgets.

A candidate set is bounded by its limit. Windows without a partition key run on such sets only.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.numbers import cosine_to
from loomspark.functions.text import token_estimate, tokens

#: Fixed values of the ranking formulas.
BM25_K1, BM25_B = 1.5, 0.75
VECTOR_SHARE, TEXT_SHARE = 0.6, 0.4
RRF_K = 60.0
SCORE_SHARE, RECENCY_SHARE = 0.7, 0.3
BOOSTS = (0.4, 0.25, 0.15, 0.08, 0.04)


def query_words(query: str) -> list[str]:
    """The distinct tokens of a query, as functions.text.tokens, worked out once and given to Spark as literals:
    it would evaluate them again for every row, and inside a lambda for every token of every row."""
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", query.lower()) if len(t) > 1))


def nearest(vectors: DataFrame, query: list[float], k: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the highest cosine similarity ``sim`` (6 digits), ties by id: a distributed top-k."""
    scored = vectors.withColumn("sim", F.round(cosine_to(F.col(vector), query), 6)).drop(vector)
    return scored.filter(F.col("sim").isNotNull()).orderBy(F.desc("sim"), F.asc(id)).limit(k)


def bm25(candidates: DataFrame, query: str, k1: float = BM25_K1, b: float = BM25_B, stop_words: list[str] | None = None) -> DataFrame:
    """Add ``bm25`` (6 digits) to a bounded candidate set with a ``text``.

    Counts, document frequencies and the mean length come from the set itself. A query term that occurs
    twice counts twice. One pass: every candidate meets every query term as a row.
    """
    own = lambda text: F.filter(tokens(text), lambda t: ~t.isin(stop_words)) if stop_words else tokens(text)
    everything = Window.partitionBy()
    rows = candidates.withColumn("_tokens", own(F.col("text"))).withColumn("_len", F.size("_tokens"))
    rows = rows.withColumns({"_n": F.count("*").over(everything), "_avg": F.avg("_len").over(everything)})
    rows = rows.select("*", F.posexplode_outer(own(F.lit(query))).alias("_at", "_term"))
    tf = F.size(F.filter("_tokens", lambda t: t == F.col("_term")))
    rows = rows.withColumn("_tf", F.when(F.col("_term").isNull(), 0).otherwise(tf))
    rows = rows.withColumn("_df", F.count_if(F.col("_tf") > 0).over(Window.partitionBy("_at")))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    norm = F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg"))
    part = F.when(F.col("_tf") > 0, idf * F.col("_tf") * (k1 + 1) / norm).otherwise(0.0)
    keys = candidates.columns
    return rows.groupBy(*keys).agg(F.round(F.sum(part), 6).alias("bm25"))


def min_max(candidates: DataFrame, value: str, out: str, partition: list[str] | None = None) -> DataFrame:
    """Scale to 0..1 over the set (or over each partition); 0 where all are equal."""
    w = Window.partitionBy(*(partition or []))
    low, high = F.min(value).over(w), F.max(value).over(w)
    return candidates.withColumn(out, F.round(F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)), 6))


def nearest_docs(docs: DataFrame, vectors: DataFrame, query_vector: list[float], k: int) -> DataFrame:
    """The k rows of ``docs`` (doc_id) whose vectors (doc_id, embedding) are nearest, with ``sim``.

    Only ids decide which vectors take part; texts join the k found, which are broadcast, as k bounds them.
    """
    own = vectors.select("doc_id", "embedding").join(docs.select("doc_id"), "doc_id", "left_semi")
    return docs.join(F.broadcast(nearest(own, query_vector, k, "doc_id")), "doc_id")


def hybrid(
    docs: DataFrame, vectors: DataFrame, query_vector: list[float], query: str, limit: int, offset: int = 0, boost: DataFrame | None = None,
    sort: str = "score", reranker: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Top ``limit`` by 0.6 cosine + 0.4 scaled BM25 + boost, over three times as many nearest vectors.

    ``docs`` has doc_id and text, and is filtered beforehand as the search wants it; ``vectors`` has
    doc_id and embedding; ``boost`` has doc_id and boost. ``reranker`` may replace ``score`` on all
    candidates where the score is what they are sorted by. ``sort`` is "score", or "date_desc" or "date_asc" by created_at.
    """
    if sort not in ("score", "date_desc", "date_asc"):
        raise ValueError("sort must be score, date_desc or date_asc")
    found = nearest_docs(docs, vectors, query_vector, 3 * (limit + offset))
    found = min_max(bm25(found, query), "bm25", "text_score")
    if boost is not None:
        found = found.join(boost, "doc_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    else:
        found = found.withColumn("boost", F.lit(0.0))
    score = VECTOR_SHARE * F.col("sim") + TEXT_SHARE * F.col("text_score") + F.col("boost")
    found = found.withColumn("score", F.round(score, 6))
    found = reranker(found) if reranker and sort == "score" else found
    order = {"score": F.desc("score"), "date_desc": F.desc_nulls_last("created_at"), "date_asc": F.asc_nulls_last("created_at")}
    return found.orderBy(order[sort], F.desc("score"), "doc_id").offset(offset).limit(limit)


#: Fixed values of the evaluation's variant: its k1, and the boosts of the texts with most query tokens.
EVAL_K1, EVAL_BOOST, EVAL_BOOSTED = 1.2, 0.15, 3


def hybrid_eval(docs: DataFrame, vectors: DataFrame, query_vector: list[float], query: str, limit: int, stop_words: list[str]) -> DataFrame:
    """The variant of :func:`hybrid` that the evaluation measures: both parts scaled over the candidates, stop words
    out, and 0.15, 0.1 and 0.05 for the three candidates with most distinct query tokens (ties by similarity)."""
    found = bm25(nearest_docs(docs, vectors, query_vector, 3 * limit), query, EVAL_K1, BM25_B, stop_words)
    found = min_max(min_max(found, "bm25", "text_score"), "sim", "vector_score")
    words = F.array(*(F.lit(w) for w in query_words(query) if w not in set(stop_words))).cast("array<string>")
    found = found.withColumn("_met", F.size(F.array_intersect(tokens(F.col("text")), words)))
    place = F.row_number().over(Window.orderBy(F.desc("_met"), F.desc("sim"), "doc_id")) - 1
    boost = F.when(place < EVAL_BOOSTED, EVAL_BOOST * (1 - place / EVAL_BOOSTED)).otherwise(0.0)
    found = found.withColumn("boost", F.round(boost, 6)).drop("_met")
    score = VECTOR_SHARE * F.col("vector_score") + TEXT_SHARE * F.col("text_score") + F.col("boost")
    return found.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "doc_id").limit(limit)


def temporal(search: Callable[[int], DataFrame], limit: int, created: str = "created_at", id: str = "doc_id") -> DataFrame:
    """The ``limit`` best of twice as many hits of ``search`` (limit) once recency is blended in: ``reranked``."""
    return recency(search(2 * limit), created=created, id=id).orderBy(F.desc("reranked"), id).limit(limit)


def entity_boosts(entities: DataFrame, mentions: DataFrame, query: str) -> DataFrame:
    """(doc_id, boost): the five longest names of entities that a query token is part of, or an alias of, give 0.4 down to 0.04
    to each document that mentions them, once an entity."""
    asked = query_words(query)
    met = reduce(lambda a, t: a | F.lower("name").contains(t), asked, F.lit(False))
    if "aliases" in entities.columns:
        met = met | F.coalesce(F.exists("aliases", lambda a: F.lower(a).isin(asked)), F.lit(False))
    hit = entities.filter(met)
    best = hit.orderBy(F.desc(F.length("name")), "entity_id").limit(len(BOOSTS))
    ranked = best.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(F.length("name")), "entity_id")))
    ranked = ranked.select("entity_id", F.element_at(F.array(*(F.lit(x) for x in BOOSTS)), F.col("_r")).alias("_b"))
    seen = mentions.select("entity_id", "doc_id").distinct()
    return seen.join(ranked, "entity_id").groupBy("doc_id").agg(F.round(F.sum("_b"), 6).alias("boost"))


def full_text(docs: DataFrame, query: str) -> DataFrame:
    """Documents with any query token; score is the sum over distinct query tokens of tf / (tf + 1).

    A text is split once for the filter and once for the score: the tokens that the query has are bound
    as a lambda variable, and only these few are counted.
    """
    words = F.array(*(F.lit(t) for t in query_words(query))).cast("array<string>")
    own = F.array(F.filter(tokens(F.col("text")), lambda t: F.array_contains(words, t)))
    count = lambda met, w: F.size(F.filter(met, lambda t: t == w))
    score = F.transform(own, lambda met: F.aggregate(F.array_distinct(met), F.lit(0.0), lambda s, w: s + count(met, w) / (count(met, w) + F.lit(1.0))))
    return docs.filter(F.arrays_overlap(tokens(F.col("text")), words)).withColumn("score", F.round(F.get(score, F.lit(0)), 6))


def rrf(left: DataFrame, right: DataFrame, id: str, k: float = RRF_K) -> DataFrame:
    """Fuse two bounded lists (id, rank): 1 / (k + rank) of either, full outer."""
    both = left.select(id, F.col("rank").alias("_l")).join(right.select(id, F.col("rank").alias("_r")), id, "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return both.select(id, F.round(part("_l") + part("_r"), 6).alias("score"))


def with_rank(limited: DataFrame, *order: Column) -> DataFrame:
    """Number a set that a limit has bounded."""
    return limited.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def recency(hits: DataFrame, score: str = "score", created: str = "created_at", id: str = "doc_id") -> DataFrame:
    """0.7 score + 0.3 (1 - rank / n), rank 0 for the newest of the dated; undated rows get no part of it."""
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(created), id)) - 1
    fresh = F.when(F.col(created).isNull(), 0.0).otherwise(1 - rank / F.count("*").over(everything))
    return hits.withColumn("reranked", F.round(SCORE_SHARE * F.col(score) + RECENCY_SHARE * fresh, 6))


def token_budget(hits: DataFrame, budget: int, rank: str = "rank", stored: str | None = None) -> DataFrame:
    """The greedy prefix of a ranked list that fits ``budget`` tokens; it stops at the first that does
    not fit. If that is the first of all, its text is cut to budget * 4 - 1 characters and an ellipsis."""
    if budget is None or budget <= 0:
        return hits.withColumns({"tokens": token_estimate(F.col("text"), F.col(stored) if stored else None), "truncated": F.lit(False)})
    rows = hits.withColumn("tokens", token_estimate(F.col("text"), F.col(stored) if stored else None))
    upto = F.sum("tokens").over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    first = F.row_number().over(Window.orderBy(rank)) == 1
    rows = rows.withColumn("truncated", first & (F.col("_upto") > budget)).filter((F.col("_upto") <= budget) | F.col("truncated"))
    cut = F.concat(F.left("text", F.lit(budget * 4 - 1)), F.lit("…"))
    return rows.withColumns(
        {"text": F.when(F.col("truncated"), cut).otherwise(F.col("text")), "tokens": F.when(F.col("truncated"), F.lit(budget).cast("long")).otherwise(F.col("tokens"))}
    ).drop("_upto")


def expansion_terms(hits: DataFrame, stop_words: list[str], top: int = 10) -> DataFrame:
    """The most frequent tokens of the first-pass hits that are no stop words: (term, n)."""
    words = hits.select(F.explode(tokens(F.col("text"))).alias("term")).filter(~F.col("term").isin(stop_words))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def merge_best(*lists: DataFrame, id: str = "doc_id") -> DataFrame:
    """Union of hit lists, the highest score for each id."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out.groupBy(id).agg(F.max("score").alias("score"))


def result_metadata(hits: DataFrame) -> DataFrame:
    """One row over a page of hits: score mean, least and most, dates, distinct documents, hits by type."""
    by_type = hits.groupBy("type").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.min("score").alias("lo"), F.max("score").alias("hi"),
                                       F.min("created_at").alias("e"), F.max("created_at").alias("l"), F.collect_set("doc_id").alias("ids"))
    entry = F.concat_ws(":", "type", F.col("n").cast("string"))
    return by_type.agg(
        F.sum("n").alias("hits"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"), F.min("lo").alias("min_score"), F.max("hi").alias("max_score"),
        F.min("e").alias("earliest"), F.max("l").alias("latest"), F.size(F.array_distinct(F.flatten(F.collect_list("ids")))).cast("long").alias("documents"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("by_type"),
    )
