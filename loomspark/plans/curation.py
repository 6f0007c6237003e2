"""Queries of ingestion, curation, isolation and the work queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.numbers import weakened
from loomspark.operators import curation as C
from loomspark.plans.views import DOCS_SQL, docs
from loomspark.registry import query, table


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha256, count(*) AS copies FROM documents GROUP BY text")
def sha_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_TAG = "(?:memory|brain|mcp|system|hyobject|chunk|ref|source|id):[^\\]]+"
SANITIZE_SQL = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({{0}}, '(?i)\[\[{_TAG}\]\]', '', 'g'),
  '(?i)\[{_TAG}\]', '', 'g'), '(?s)<!--.*?-->', '', 'g'), ' {{{{3,}}}}', '  ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"""


@query(f"SELECT page_id, sha256({SANITIZE_SQL.format('html')}) AS sha256, length({SANITIZE_SQL.format('html')})::BIGINT AS n_chars FROM pages")
def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = T.sanitize(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(clean, 256).alias("sha256"), F.length(clean).cast("long").alias("n_chars"))


@query(f"""WITH {DOCS_SQL}, s AS (SELECT doc_id, workspace, sha256({SANITIZE_SQL.format("text")}) AS h FROM docs)
SELECT doc_id, row_number() OVER (PARTITION BY workspace, h ORDER BY doc_id) > 1 OR EXISTS (SELECT 1 FROM s o WHERE o.doc_id % 3 = 0 AND o.workspace = s.workspace AND o.h = s.h) AS deduped
FROM s WHERE doc_id % 3 <> 0""")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = C.content_hash(docs(spark, sf_dir)).select("doc_id", "workspace", "sha256")
    return C.ingest(hashed.filter("doc_id % 3 <> 0"), hashed.filter("doc_id % 3 = 0")).select("doc_id", "deduped")


@query("""SELECT doc_id, doc_id || ':' || i AS chunk_id, i::INT AS chunk_index, substring(text, i * 700 + 1, 800) AS text
FROM documents, unnest(range(0, greatest(1, ceil((length(text) - 100) / 700)::BIGINT))) AS u(i)""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_windows(F.col("text"))).alias("chunk_index", "text"))
    return d.withColumn("chunk_id", F.concat_ws(":", "doc_id", "chunk_index"))


@query(r"""WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(trim(lower(p_type)), '[_-]+', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM part)
SELECT p_partkey, CASE WHEN length(t) <= 40 AND regexp_matches(t, '^[a-z][a-z0-9]*(?: [a-z0-9]+){0,3}$') THEN t END AS name FROM n""")
def type_name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.type_name(F.col("p_type")).alias("name"))


@query("""SELECT event_id, regexp_replace(trim(lower('Currently now ' || event_type)), '^((now|currently|still|recently|previously|formerly|today)\\s+)+', '') AS predicate FROM events""".replace("\\\\", "\\"))
def predicate_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.predicate_name(F.concat(F.lit("Currently now "), "event_type")).alias("predicate"))


@query(r"""SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '\b[A-Z][a-zA-Z0-9_-]{2,}\b')[:8])) AS names FROM documents WHERE text IS NOT NULL""")
def fake_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the word boundary is the ASCII one, in Spark as in SQL
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.array_sort(T.capitalised(F.col("text"))).alias("names"))


TRIPLES_SQL = "t AS (SELECT ' ' || c_name || ' ' AS subject, 'Currently ' || o_orderpriority AS predicate, o_orderstatus AS object, round((o_orderkey % 13) / 10.0::DOUBLE, 6) AS confidence FROM orders JOIN customer ON c_custkey = o_custkey)"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("subject"), F.concat(F.lit("Currently "), "o_orderpriority").alias("predicate"),
                    F.col("o_orderstatus").alias("object"), F.round(F.col("o_orderkey") % 13 / 10, 6).alias("confidence"))


@query(f"""WITH {TRIPLES_SQL} SELECT lower(trim(subject)) AS s, regexp_replace(trim(lower(predicate)), '^currently ', '') AS predicate, lower(object) AS o, max(least(confidence, 1)) AS confidence FROM t GROUP BY ALL""")
def triple_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unique_triples(triples(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN value / 100 >= 0.6 AND event_type IN ('click', 'purchase') THEN 'promoted' ELSE 'pending' END AS state FROM events""")
def promote_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), (F.col("value") / 100).alias("confidence"))
    kinds = spark.createDataFrame([("click",), ("purchase",)], "kind string")
    return C.promote(seen, kinds).select("event_id", "state")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT lower(trim(x)) AS name FROM (SELECT p_type AS x FROM part UNION ALL SELECT regexp_extract(p_type, '^(\\S+ \\S+)', 1) FROM part UNION ALL SELECT regexp_extract(p_type, '(\\S+)$', 1) FROM part) WHERE trim(x) <> ''),
b AS (SELECT a.name, arg_max(l.name, (length(l.name), l.name)) AS longer FROM n a JOIN n l ON length(l.name) > length(a.name) AND (starts_with(l.name, a.name || ' ') OR suffix(l.name, ' ' || a.name)) GROUP BY a.name),
w AS (SELECT name, name AS c, 0 AS k FROM n UNION ALL SELECT w.name, b.longer, k + 1 FROM w JOIN b ON b.name = w.c)
SELECT name, arg_max(c, k) AS canonical FROM w GROUP BY name""".replace("\\\\", "\\"))
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = table(spark, sf_dir, "part").select(F.col("p_type").alias("name"))
    names = full.union(full.select(F.regexp_extract("name", r"^(\S+ \S+)", 1))).union(full.select(F.regexp_extract("name", r"(\S+)$", 1)))
    return C.resolve_names(names.filter("trim(name) <> ''").withColumn("kind", F.lit("part"))).select("name", "canonical")


@query("""WITH e AS (SELECT lower(n_name) AS name, n_nationkey AS id FROM nation UNION ALL SELECT lower(r_name), 100 + r_regionkey FROM region WHERE r_regionkey > 0)
SELECT n_nationkey, s.id AS subject_id, o.id AS object_id FROM nation JOIN region ON r_regionkey = n_regionkey JOIN e s ON s.name = lower(n_name) JOIN e o ON o.name = lower(r_name) WHERE s.id <> o.id""")
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    entities = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("entity_id"))
    entities = entities.union(region.filter("r_regionkey > 0").select("r_name", F.col("r_regionkey") + 100))
    facts = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("subject"), F.col("r_name").alias("object"))
    return C.resolve_endpoints(facts, entities).select("n_nationkey", "subject_id", "object_id")


PROPOSED_SQL = r"""o AS (SELECT trim(regexp_replace(lower(p_type), '[ ]+', ' ', 'g')) AS name, p_brand AS source, round(p_size / 50.0::DOUBLE, 6) AS confidence FROM part),
prop AS (SELECT name, count(DISTINCT source) AS seen_count, max(confidence) AS confidence FROM o WHERE confidence >= 0.6 AND length(name) <= 40
  AND regexp_matches(name, '^[a-z][a-z0-9]*(?: [a-z0-9]+){0,3}$') AND name NOT IN (SELECT trim(lower(p_type)) FROM part WHERE p_partkey <= 5) GROUP BY name)"""


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    seen = part.select(F.col("p_type").alias("name"), F.col("p_brand").alias("source"), F.round(F.col("p_size") / 50, 6).alias("confidence"))
    return C.schema_proposals(seen, part.filter("p_partkey <= 5").select(F.col("p_type").alias("name")))


@query(f"WITH {PROPOSED_SQL} SELECT * FROM prop")
def schema_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proposals(spark, sf_dir)


@query(f"""WITH {PROPOSED_SQL}, fit AS (SELECT * FROM prop WHERE seen_count >= 3 AND confidence >= 0.8)
SELECT name, seen_count, confidence, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY name) AS type_id, false AS reused FROM fit""")
def schema_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("type_id"))
    return C.promote_types(_proposals(spark, sf_dir), catalog)


@query("""WITH d AS (SELECT user_id % 50 AS id, arg_max(event_type, (ts, event_id)) AS d FROM events GROUP BY 1)
SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'rejected' WHEN d = 'click' THEN 'approved' WHEN d = 'view' THEN 'rejected' ELSE 'pending' END AS state
FROM customer LEFT JOIN d ON d.id = c_custkey""")
def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposal_id"), F.when(F.col("c_nationkey") % 3 == 0, "rejected").otherwise("pending").alias("state"))
    verb = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "reject").otherwise("none")
    decisions = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("proposal_id"), verb.alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    return C.review(proposals, decisions).select(F.col("proposal_id").alias("c_custkey"), "state")


@query("""WITH known AS (SELECT lower(p_brand) AS n, p_type AS k, min(p_partkey) AS e FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2)
SELECT p_partkey AS proposal_id, coalesce(e::VARCHAR, sha256(p_type || chr(10) || lower(p_brand))) AS entity_id, e IS NULL AS made
FROM part LEFT JOIN known ON n = lower(p_brand) AND k = p_type WHERE p_size % 2 = 0""")
def review_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of even size are approved proposals of a brand and kind; a third of the parts are entities."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), "p_size")
    proposals = p.select(F.col("p_partkey").alias("proposal_id"), "name", "kind", F.when(F.col("p_size") % 2 == 0, "approved").otherwise("pending").alias("state"))
    return C.approved_entities(proposals, p.filter("p_partkey % 3 = 0").withColumnRenamed("p_partkey", "entity_id"))


@query("""WITH cur AS (SELECT DISTINCT l_suppkey AS s, l_returnflag AS p, l_partkey AS o FROM lineitem WHERE l_linestatus = 'O'),
w AS (SELECT event_id, user_id % 100 AS s, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'N' ELSE 'R' END AS p, event_id % 200 AS o FROM events WHERE value >= 10),
f AS (SELECT s, p, o, min(event_id) AS first FROM w GROUP BY ALL)
SELECT event_id AS proposal_id, s AS subject, p AS predicate, o AS object, CASE WHEN s NOT IN (SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part WHERE p_size > 5) OR o NOT IN (SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part WHERE p_size > 5) THEN 'blocked'
  WHEN EXISTS (SELECT 1 FROM cur WHERE (cur.s, cur.p, cur.o) = (w.s, w.p, w.o)) THEN 'kept' WHEN event_id > first THEN 'superfluous' ELSE 'made' END AS outcome
FROM w JOIN f USING (s, p, o)""")
def review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of some value are approved relations of suppliers and larger parts; order lines still open are the edges."""
    verb = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "N").otherwise("R")
    state = F.when(F.col("value") >= 10, "approved").otherwise("pending")
    ends = {"proposal_id": F.col("event_id"), "subject": F.col("user_id") % 100, "predicate": verb, "object": F.col("event_id") % 200, "state": state}
    proposals = table(spark, sf_dir, "events").select(*(c.alias(n) for n, c in ends.items()))
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id")).union(table(spark, sf_dir, "part").filter("p_size > 5").select("p_partkey"))
    opened = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'")
    edges = opened.select(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("l_partkey").alias("object"))
    return C.approved_edges(proposals, ids, edges)


@query("""SELECT user_id, event_type, CAST(ts AS DATE) AS day, arg_min(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS replays FROM events GROUP BY 1, 2, 3""")
def idempotent_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    keys = ["user_id", "event_type", "day"]
    kept, again = C.write_once(e, keys, F.col("ts"), F.col("event_id"))
    counts = again.groupBy(*keys).agg(F.count("*").alias("replays"))
    return kept.join(counts, keys, "left").select(*keys, "event_id", F.coalesce("replays", F.lit(0).cast("long")).alias("replays"))


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 1), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 2),
b AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS k, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op,
  o.o_orderpriority AS op1, n.o_orderpriority AS np1, o.o_orderstatus AS os, n.o_orderstatus AS ns FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey)
SELECT k AS o_orderkey, op, 'o_orderpriority' AS "column", op1 AS old_value, np1 AS new_value FROM b WHERE op1 IS DISTINCT FROM np1
UNION ALL SELECT k, op, 'o_orderstatus', os, ns FROM b WHERE os IS DISTINCT FROM ns""")
def audit_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    new = orders.filter("o_orderkey % 10 <> 2").withColumns(
        {"o_orderpriority": F.when(F.col("o_orderkey") % 4 == 0, "CHANGED").otherwise(F.col("o_orderpriority")), "o_orderstatus": F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderstatus"))}
    )
    return C.changes(orders.filter("o_orderkey % 10 <> 1"), new, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


QUEUE_SQL = "queue AS (SELECT event_id AS chunk_id, ['pending', 'processing', 'done', 'pending'][event_id % 4 + 1] AS status, (event_id % 5)::INT AS attempts, ts AS updated_at FROM events)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in ("pending", "processing", "done", "pending"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("chunk_id"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("attempts"), F.col("ts").alias("updated_at"))


@query(f"WITH {QUEUE_SQL} SELECT chunk_id, 'processing' AS status, attempts + 1 AS attempts FROM queue WHERE status = 'pending' AND attempts < 3 ORDER BY updated_at, chunk_id LIMIT 10")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.claim(queue(spark, sf_dir), 10).select("chunk_id", "status", "attempts")


@query(f"""WITH {QUEUE_SQL} SELECT CASE WHEN status = 'processing' AND updated_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 5 MINUTE THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
count(*) AS n FROM queue GROUP BY 1""")
def lease_reaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = C.reap(queue(spark, sf_dir), F.expr("timestamp_ntz'2024-01-15 00:00:00'"))
    return done.groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {DOCS_SQL} SELECT doc_id, sharing FROM docs WHERE sharing IS DISTINCT FROM 1 OR source = 'src3'")
def visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.visible(docs(spark, sf_dir).withColumn("agent", F.col("source")), "src3").select("doc_id", "sharing")


@query(f"""WITH {DOCS_SQL} SELECT doc_id, workspace FROM docs WHERE workspace = 'src5' AND sharing IN (2, 4, 5)""")
def workspace_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomspark.plans.session import Session

    own = Session({"documents": docs(spark, sf_dir).withColumn("agent", F.col("source"))}, workspace="src5", actor="someone", role="llm")
    return own.table("documents").select("doc_id", "workspace")


@query("""WITH r(id, p, m, n) AS (VALUES (1, 10, 'ECONOMY', NULL), (2, 20, NULL, 'green'), (3, 30, NULL, NULL)), d AS (SELECT p_partkey, string_split(p_type, ' ')[1] AS m, p_name FROM part)
SELECT p_partkey, arg_min(r.id, (r.p, r.id)) AS rule_id FROM d JOIN r ON (r.m IS NULL OR r.m = d.m) AND (r.n IS NULL OR contains(lower(p_name), lower(r.n))) GROUP BY p_partkey""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(1, 10, "ECONOMY", None), (2, 20, None, "green"), (3, 30, None, None)], "rule_id int, priority int, mime_type string, name_contains string")
    d = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split("p_type", " "), 1).alias("mime_type"), F.col("p_name").alias("name"))
    return C.first_rule(d, rules, "p_partkey")


@query("SELECT event_id, round(greatest(0, least(value / 100, 1) * (1 - 0.4::DOUBLE * 0.5)), 6) AS weakened FROM events")
def contradiction_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(weakened(F.col("value") / 100, F.lit(0.5)), 6).alias("weakened"))
