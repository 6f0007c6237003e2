"""Queries of the evidence family; sightings are events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import confidence_band
from loomspark.operators import evidence as E
from loomspark.plans.views import EDGES_SQL, observations
from loomspark.registry import query

MAX_SQL = f"{EDGES_SQL}, ps AS (SELECT subject, predicate, object, source, max(confidence) AS confidence FROM obs GROUP BY ALL)"
NOISY = "least(greatest(0.95::DOUBLE, m), 1 - (1 - m) * p / (1 - 0.4::DOUBLE * m))"
OR_SQL = f"""{MAX_SQL}, agg AS (SELECT subject, predicate, object, count(*) AS sources, max(confidence) AS m, product(1 - 0.4::DOUBLE * confidence) AS p
  FROM ps WHERE confidence > 0 GROUP BY ALL)"""


@query(f"WITH {MAX_SQL} SELECT * FROM ps")
def evidence_max_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strongest_per_source(observations(spark, sf_dir))


@query(f"WITH {OR_SQL} SELECT subject, predicate, object, sources, round({NOISY}, 6) AS confidence FROM agg")
def noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.compounded(E.strongest_per_source(observations(spark, sf_dir)))


@query(f"WITH {EDGES_SQL} SELECT subject, predicate, object, count(DISTINCT source) AS sources FROM obs GROUP BY ALL HAVING count(DISTINCT source) >= 2")
def corroborated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.corroborated(observations(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT subject, object, count(DISTINCT source) AS sources, count(*) AS sightings FROM obs GROUP BY ALL")
def independent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy("subject", "object").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("sightings"))


@query(f"""WITH {EDGES_SQL}, f AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY subject, predicate, object, source ORDER BY observed_at, event_id) = 1),
s AS (SELECT *, max(confidence) OVER w AS m, exp(sum(ln(1 - 0.4::DOUBLE * confidence)) OVER w) AS p FROM f
  WINDOW w AS (PARTITION BY subject, predicate, object ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN m > 0 THEN round({NOISY}, 3) ELSE 0 END AS v FROM s)
SELECT subject, predicate, object, count(*) AS steps, string_agg(format('{{:.3f}}', v), ' -> ' ORDER BY observed_at, event_id) AS trend FROM v GROUP BY ALL HAVING count(*) >= 2""")
def confidence_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trend(observations(spark, sf_dir))


SPANS_SQL = f"""{EDGES_SQL}, l AS (SELECT *, CASE WHEN lag(object) OVER w IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh FROM obs
  WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS interval FROM l),
heads AS (SELECT subject, predicate, object, interval, min(observed_at) AS valid_from, arg_min(confidence, (observed_at, event_id)) AS opened FROM runs GROUP BY ALL),
spans AS (SELECT *, lead(valid_from) OVER w AS valid_to, lead(opened) OVER w AS closed_by FROM heads WINDOW w AS (PARTITION BY subject, predicate ORDER BY interval)),
proof AS (SELECT subject, predicate, object, interval, source, arg_min(confidence, (observed_at, event_id)) AS c FROM runs GROUP BY ALL),
best AS (SELECT s.subject, s.predicate, s.object, s.interval, p.source, max(p.c) AS c FROM spans s JOIN proof p
  ON s.subject = p.subject AND s.predicate = p.predicate AND s.object = p.object AND p.interval <= s.interval GROUP BY ALL),
agg AS (SELECT subject, predicate, object, interval, max(c) AS m, round(product(1 - 0.4::DOUBLE * c), 14) AS p FROM best WHERE c > 0 GROUP BY ALL),
conf AS (SELECT s.*, coalesce(round({NOISY}, 6), 0) AS c FROM spans s LEFT JOIN agg a ON s.subject = a.subject AND s.predicate = a.predicate AND s.object = a.object AND s.interval = a.interval)"""


@query(f"""WITH {SPANS_SQL} SELECT subject, predicate, object, interval, valid_from, valid_to, round(closed_by, 6) AS closed_by,
round(CASE WHEN valid_to IS NULL THEN c ELSE greatest(0, c * (1 - 0.4::DOUBLE * closed_by)) END, 6) AS confidence FROM conf""")
def contradiction_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.intervals(observations(spark, sf_dir))


@query(f"""WITH {SPANS_SQL} SELECT subject, predicate, object, interval, lead(interval) OVER w AS superseded_by,
CASE WHEN lead(interval) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS state FROM spans
WHERE (subject, predicate) IN (SELECT (subject, predicate) FROM spans GROUP BY ALL HAVING count(*) > 1) WINDOW w AS (PARTITION BY subject, predicate ORDER BY interval)""")
def claims_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ledger(E.intervals(observations(spark, sf_dir)))


@query(f"""WITH {EDGES_SQL} SELECT subject, predicate, object, event_id, confidence FROM obs
QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, observed_at DESC, event_id DESC) = 1""")
def best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.best_claims(observations(spark, sf_dir), ["subject", "predicate"]).select("subject", "predicate", "object", "event_id", "confidence")


AS_OF = "2024-01-15 00:00:00"


@query(f"WITH {SPANS_SQL} SELECT subject, object, interval, valid_from FROM spans WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')")
def current_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = E.intervals(observations(spark, sf_dir))
    at = F.expr(f"timestamp_ntz'{AS_OF}'")
    return spans.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("subject", "object", "interval", "valid_from")


@query(f"WITH {SPANS_SQL} SELECT subject, object, interval, valid_to FROM spans WHERE valid_to <= TIMESTAMP '{AS_OF}'")
def superseded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = E.intervals(observations(spark, sf_dir))
    return spans.filter(F.col("valid_to") <= F.expr(f"timestamp_ntz'{AS_OF}'")).select("subject", "object", "interval", "valid_to")


@query(f"""WITH {EDGES_SQL} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM obs WHERE confidence IS NOT NULL GROUP BY ALL""")
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).filter("confidence IS NOT NULL").groupBy(confidence_band(F.col("confidence")).alias("band")).agg(F.count("*").alias("n"))
