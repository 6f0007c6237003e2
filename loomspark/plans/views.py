"""How the driver's tables stand for the concepts of a memory store, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.registry import table

#: Tokens in DuckDB's SQL, as functions.text.tokens.
TOKENS = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda t: length(t) > 1)"
DOCS_SQL = """docs AS (SELECT doc_id, text, lang, source, source AS workspace, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 2 END AS sharing,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INT) AS created_at FROM documents)"""
EDGES_SQL = """obs AS (SELECT event_id, user_id AS subject, 'did' AS predicate, event_type AS object, strftime(ts, '%Y-%m-%d') AS source,
  round(least(greatest(value / 100, 0), 1), 6) AS confidence, ts AS observed_at FROM events)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with workspace (their source), sharing (1 private) and created_at (an hour apart)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    created = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0)")
    return d.withColumns({"workspace": F.col("source"), "sharing": F.when(F.col("doc_id") % 7 == 0, 1).otherwise(2), "created_at": created})


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sightings of facts: a user did something, seen by a day, with a confidence."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"),
        F.date_format("ts", "yyyy-MM-dd").alias("source"),
        F.round(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"), F.col("ts").alias("observed_at"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    """One given vector, by id."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def query_text(spark: SparkSession, sf_dir: str, item_id: int = 3) -> str:
    return table(spark, sf_dir, "benchmark").filter(F.col("item_id") == item_id).select("text").first()[0]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings by the document they stand for."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
