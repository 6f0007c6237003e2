"""Queries of sources, chunking, logging and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import structured as S
from loomspark.operators import extraction
from loomspark.operators.lineage import new_folder
from loomspark.plans.evidence import NOISY, OR_SQL
from loomspark.plans.views import observations
from loomspark.registry import query, table
from loomspark.sources import exports, files
from loomspark.streaming import pipelines

NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query()
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = exports.render(table(spark, sf_dir, "conversations"))
    return rendered.select("conv_id", F.posexplode(S.paragraph_chunks(F.col("text"))).alias("chunk_index", "text"))


@query()
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.concat(F.lit('{"entities": [{"p": '), "props", F.lit('}, {"p": '), "props", F.lit("}]}"))
    cut = F.left(whole, F.length(whole) - (F.col("event_id") % 12 + 1).cast("int"))
    fixed = table(spark, sf_dir, "events").select("event_id", S.repaired_json(cut).alias("json"))
    return fixed.select("event_id", "json", F.get_json_object("json", "$.entities[0].p.k").alias("k"))


@query(r"""SELECT page_id, CASE WHEN e = 'html' THEN 'text/html' WHEN e = 'csv' THEN 'text/csv' ELSE 'application/octet-stream' END AS mime_type
FROM (SELECT page_id, lower(string_split(regexp_replace(url, '[?#].*', ''), '.')[-1]) AS e FROM pages)""")
def mime_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", files.mime_type(F.regexp_replace("url", r"[?#].*", "")).alias("mime_type"))


@query("""SELECT event_id, '[REDACTED]' AS api_token, '[REDACTED]' AS password, event_type FROM events""")
def log_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.create_map(F.lit("api_token"), F.col("user_id").cast("string"), F.lit("password"), F.col("props"), F.lit("event_type"), F.col("event_type"))
    logged = table(spark, sf_dir, "events").select("event_id", S.redacted(entry).alias("m"))
    return logged.select("event_id", *[F.element_at("m", k).alias(k) for k in ("api_token", "password", "event_type")])


@query()
def name_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.name_uuid(NAMESPACE, F.col("c_name")).alias("uuid"))


def _scratch(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; time columns of the stream are instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, as the table may be one file or a folder of them
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT count(*) AS kept, count(DISTINCT user_id) AS users FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) FROM events)")
def stream_idempotent_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark)
    keyed = _event_stream(spark, sf_dir).withColumn("day", F.to_date("ts"))
    unique = pipelines.unique_events(keyed, ["user_id", "event_type", "day"], "at", "400 days")
    pipelines.append_batches(unique.drop("at"), f"{scratch}/offsets", f"{scratch}/events")
    return spark.read.parquet(f"{scratch}/events").agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("users"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'idempotency_key' WHEN event_id % 11 = 0 THEN 'trace_id' WHEN event_type = 'error' THEN 'kind' END AS problem FROM events)
SELECT coalesce(problem, 'valid') AS outcome, count(*) AS n, min(event_id) AS first FROM e GROUP BY 1""")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, id = _scratch(spark), F.col("event_id")
    key = F.when(id % 7 == 0, " ").otherwise(id.cast("string")).alias("idempotency_key")
    trace, kind = F.when(id % 11 != 0, id.cast("string")).alias("trace_id"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("kind")
    pipelines.quarantine_stream(_event_stream(spark, sf_dir).select("event_id", key, trace, kind), f"{scratch}/offsets", f"{scratch}/events", f"{scratch}/quarantine")
    good = spark.read.parquet(f"{scratch}/events").select(F.lit("valid").alias("outcome"), "event_id")
    both = good.unionByName(spark.read.parquet(f"{scratch}/quarantine").select(F.col("problem").alias("outcome"), "event_id"))
    return both.groupBy("outcome").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query(f"WITH {OR_SQL} SELECT subject, predicate, object, sources, round({NOISY}, 6) AS confidence FROM agg")
def stream_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = _scratch(spark)
    schema = observations(spark, sf_dir)
    stream = _event_stream(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("subject"), F.lit("did").alias("predicate"), F.col("event_type").alias("object"),
        F.date_format("ts", "yyyy-MM-dd").alias("source"), F.round(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)), 6).alias("confidence"),
        F.col("ts").alias("observed_at"),
    ).select(*schema.columns)
    pipelines.rescore_stream(stream, f"{scratch}/offsets", f"{scratch}/evidence", f"{scratch}/scores")
    return pipelines.current_scores(spark.read.parquet(f"{scratch}/scores"))


@query(r"""WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9_-]{2,}\b')[:8])) AS name FROM documents)
SELECT doc_id, name, CASE WHEN starts_with(name, 'Orgz') THEN 'organization' ELSE 'concept' END AS kind, CASE WHEN starts_with(name, 'Orgz') THEN 0.9 ELSE 0.55 END::DOUBLE AS confidence FROM e""")
def extract_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the word boundary is the ASCII one, in Spark as in SQL
    return extraction.entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
