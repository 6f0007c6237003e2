"""Queries answered from stored indexes: full text, nearest vectors, substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.stems import stem_sql
from loomspark.operators import cells, fulltext, trigrams
from loomspark.operators.lineage import new_folder
from loomspark.plans.retrieval import STOP_SQL, VEC
from loomspark.plans.views import TOKENS
from loomspark.registry import query, table


def _words(source: str, id: str) -> str:
    listed = f"(SELECT {id} AS id, unnest({TOKENS.format('text')}) AS word FROM {source})"
    return f"(SELECT id, word, count(*) AS n FROM {listed} WHERE word NOT IN ({STOP_SQL}) GROUP BY ALL)"


TEXT_SQL = f"""tf AS (SELECT id AS doc_id, term, sum(n) AS n FROM {stem_sql(_words("documents", "doc_id"))} GROUP BY ALL),
qt AS (SELECT DISTINCT id AS query_id, term FROM {stem_sql(_words("benchmark", "item_id"))}),
hit AS (SELECT query_id, doc_id, round(sum(n / (n + 1.0::DOUBLE)), 6) AS score FROM qt JOIN tf USING (term) GROUP BY ALL)"""


def _text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed in two batches, by the half of the ids they are in."""
    docs, path = table(spark, sf_dir, "documents"), new_folder(spark, "text-index")
    middle = docs.agg(F.avg("doc_id")).first()[0] or 0
    fulltext.append(path, docs.filter(F.col("doc_id") <= middle), "first")
    fulltext.append(path, docs.filter(F.col("doc_id") > middle), "second")
    return fulltext.opened(spark, path)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"""WITH {TEXT_SQL} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM hit) WHERE rank <= 10""")
def fulltext_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.search(_text_index(spark, sf_dir), _questions(spark, sf_dir), 10)


@query(f"WITH {TEXT_SQL} SELECT query_id, count(*) AS total FROM hit GROUP BY query_id")
def fulltext_index_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.matching(_text_index(spark, sf_dir), _questions(spark, sf_dir))


@query(f"""SELECT query_id, id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id)::INT AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity({VEC.format("q.embedding")}, {VEC.format("v.embedding")}), 6) AS sim
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0)) WHERE rank <= 10""")
def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    index = cells.build(rows, new_folder(spark, "cells"))
    return cells.search(index, rows.filter("vec_id % 20 = 0"), 10)


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), p AS (SELECT row_number() OVER (ORDER BY w) AS query_id, w[2:] AS part FROM w WHERE length(w) >= 4)
SELECT query_id, p_partkey AS id, p_name AS name FROM p JOIN part ON contains(lower(p_name), lower(part))""")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, path = table(spark, sf_dir, "part"), new_folder(spark, "gram-index")
    trigrams.append(path, names, "all", "p_partkey", "p_name")
    words = names.select(F.explode(F.split("p_name", " ")).alias("w")).distinct().filter(F.length("w") >= 4)
    # the distinct words of names: numbered by their order
    parts = words.select(F.expr("row_number() OVER (ORDER BY w)").cast("long").alias("query_id"), F.expr("substring(w, 2)").alias("part"))
    return trigrams.holding(trigrams.opened(spark, path), names, parts, "p_partkey", "p_name")
