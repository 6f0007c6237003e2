"""Queries of health statistics, conversations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import analytics as A
from loomspark.operators import evidence as E
from loomspark.operators import ranking as R
from loomspark.plans.evidence import SPANS_SQL
from loomspark.plans.views import DOCS_SQL, TOKENS, docs, observations
from loomspark.registry import query, table
from loomspark.sources import exports


@query(f"""WITH {DOCS_SQL} SELECT count(*) AS documents, count(DISTINCT workspace) AS workspaces, count(*) FILTER (sharing = 1) AS private,
round(100.0::DOUBLE * count(*) FILTER (source IS NOT NULL) / count(*), 1) AS attributed_pct, max(created_at) AS latest FROM docs""")
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.storage_stats(docs(spark, sf_dir).withColumn("agent", F.col("source")))


@query(f"""WITH {SPANS_SQL}, s AS (SELECT *, round(CASE WHEN valid_to IS NULL THEN c ELSE greatest(0, c * (1 - 0.4::DOUBLE * closed_by)) END, 6) AS confidence FROM conf)
SELECT count(*) FILTER (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') AS current, count(*) FILTER (valid_to <= TIMESTAMP '2024-01-15') AS superseded,
round(avg(confidence) FILTER (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15'), 3) AS mean_confidence FROM s""")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.graph_stats(E.intervals(observations(spark, sf_dir)), F.expr("timestamp_ntz'2024-01-15 00:00:00'"))


@query("""SELECT o_custkey AS agent_id, count(*) AS memories, coalesce(c_name, o_custkey::VARCHAR) AS label FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0
WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def agent_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("agent_id"), (F.col("o_orderstatus") == "P").alias("is_action"))
    agents = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("agent_id"), F.col("c_name").alias("label"))
    return A.breakdown(memories, agents)


@query("""WITH o AS (SELECT count(*) AS documents FROM orders), l AS (SELECT count(*) AS chunks, count(*) FILTER (l_linenumber > 1) AS embedded_chunks, count(*) FILTER (l_shipdate <= TIMESTAMP '1995-01-01') AS relations_superseded,
  round(avg(1 - l_discount) FILTER (l_shipdate > TIMESTAMP '1995-01-01'), 3) AS mean_relation_confidence FROM lineitem),
p AS (SELECT count(*) FILTER (p_size % 3 <> 0 AND p_size % 2 = 0) AS entities_pending, count(*) FILTER (p_size % 3 = 0) AS entities_promoted, round(100.0::DOUBLE * count(*) FILTER (p_size > 5) / count(*), 1) AS source_backed_pct,
  count(*) FILTER (p_size % 2 = 0) AS relations_pending, count(*) FILTER (p_size % 2 = 0 AND p_type IN ('SMALL', 'LARGE')) AS types_pending, count(*) FILTER (p_size % 2 = 0 AND p_type = 'SMALL') AS entity_kinds_pending,
  count(*) FILTER (p_size % 2 = 0 AND p_type = 'LARGE') AS relation_types_pending, count(*) FILTER (p_size % 2 <> 0 AND p_type IN ('SMALL', 'LARGE')) AS types_auto_promoted, count(*) AS entities FROM part),
e AS (SELECT count(*) AS memory_writes, count(*) FILTER (event_type <> 'view') AS writes_keyed, count(*) FILTER (event_type = 'error') AS writes_dead FROM events),
c AS (SELECT count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 2))
SELECT documents, chunks, embedded_chunks, p.entities, (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + chunks AS relations, relations_superseded,
  mean_relation_confidence, entities_pending, entities_promoted, source_backed_pct, relations_pending, types_pending, entity_kinds_pending, relation_types_pending, types_auto_promoted, memory_writes, writes_keyed, writes_dead,
  0 AS agents, (SELECT count(*) FROM conversations) AS session_notes, c.n AS relations_corroborated FROM o, l, p, e, c""")
def workspace_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, item, p, e, c, s = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "events", "customer", "supplier"))
    state = lambda no: F.when(F.col("p_size") % 2 == 0, "pending").otherwise(no).alias("state")
    kind = F.when(F.col("p_type") == "SMALL", "entity_kind").when(F.col("p_type") == "LARGE", "relation_type").otherwise("subtype")
    tables = {
        "documents": o, "chunks": item.select((F.col("l_linenumber") > 1).alias("embedded")), "entities": p, "people": c, "doc_people": o, "people_people": c, "doc_docs": s,
        "entity_edges": item.select(F.col("l_shipdate").alias("valid_to"), (1 - F.col("l_discount")).alias("confidence")),
        "entity_proposals": p.select(state("rejected"), F.when(F.col("p_size") % 3 == 0, F.col("p_partkey")).alias("entity_id"), F.when(F.col("p_size") > 5, F.col("p_partkey")).alias("doc_id")),
        "relation_proposals": p.select(state("rejected")), "type_proposals": p.select(state("auto_promoted"), kind.alias("kind")),
        "evidence": item.select(F.when(F.col("l_linenumber") <= 3, "entity_relation").otherwise("mention").alias("kind"), F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("doc_id")),
        "events": e.select(F.when(F.col("event_type") != "view", F.col("event_id")).alias("idempotency_key"), F.when(F.col("event_type") == "error", "dead_lettered").otherwise("completed").alias("status")),
        "notes": table(spark, sf_dir, "conversations"),
    }
    return A.health(tables, F.expr("timestamp_ntz'1995-01-01 00:00:00'"))


@query("""SELECT o_orderpriority AS workspace, o_custkey AS agent_id, count(*) AS memories, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent ' || o_custkey ELSE o_custkey::VARCHAR END AS label FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL""")
def agent_breakdown_by_workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("o_custkey").alias("agent_id")
    memories = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workspace"), id, (F.col("o_orderstatus") == "P").alias("is_action"))
    agents = memories.filter("workspace = '1-URGENT'").select("workspace", "agent_id", F.concat(F.lit("urgent "), F.col("agent_id").cast("string")).alias("label")).distinct()
    return A.breakdown(memories, agents, ("workspace", "agent_id"))


@query("""SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT user_id, round(sum(value), 4) AS spent, count(*) AS calls, round(sum(value), 4) > 3000 AS over_budget FROM events GROUP BY 1")
def spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spend(table(spark, sf_dir, "events"), "user_id", "value", 3000)


@query("""SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P",
round(avg((o_orderstatus = 'F')::INT), 6) AS share FROM orders GROUP BY 1""")
def direction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ratios(table(spark, sf_dir, "orders").withColumn("category", F.col("o_orderpriority")), ["category"], "o_orderstatus", ["F", "O", "P"])


@query(f"""WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
k AS (SELECT conv_id, turn, {TOKENS.format("text")} AS p, {TOKENS.format("nxt")} AS e FROM c WHERE nxt IS NOT NULL),
s AS (SELECT *, len(list_intersect(list_distinct(p), list_distinct(e))) AS n FROM k)
SELECT conv_id, turn, round(CASE WHEN n = 0 THEN 0 ELSE 2.0::DOUBLE * (n / len(p)) * (n / len(e)) / (n / len(p) + n / len(e)) END, 6) AS f1 FROM s""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("nxt IS NOT NULL")
    return c.select("conv_id", "turn", F.round(A.token_f1(F.col("text"), F.col("nxt")), 6).alias("f1"))


RANKED_SQL = f"""b AS (SELECT item_id, text FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM documents),
bt AS (SELECT item_id, unnest(list_distinct({TOKENS.format("text")})) AS term FROM b), hits AS (SELECT item_id, doc_id, count(*) AS n FROM bt JOIN d USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10),
ev AS (SELECT item_id, doc_id FROM b JOIN documents ON contains(documents.text, b.text))"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that share most distinct tokens with each benchmark item, by an equi-join on tokens."""
    from loomspark.functions.text import tokens

    words = lambda df, id: df.select(id, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    b = words(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "question_id"), "question_id")
    hits = b.join(words(table(spark, sf_dir, "documents"), "doc_id"), "term").groupBy("question_id", "doc_id").agg(F.count("*").alias("n"))
    best = Window.partitionBy("question_id").orderBy(F.desc("n"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter("rank <= 10")


def _evidence(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """Hits whose document holds the item verbatim. Only ranked pairs are compared."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("item"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.join(b, "question_id").join(d, "doc_id").filter(F.col("text").contains(F.col("item"))).select("question_id", "doc_id")


@query(f"""WITH {RANKED_SQL} SELECT r.item_id AS question_id, coalesce(min(rank) FILTER (e.doc_id IS NOT NULL) <= 1, false) AS ev_at_1, coalesce(min(rank) FILTER (e.doc_id IS NOT NULL) <= 5, false) AS ev_at_5,
coalesce(min(rank) FILTER (e.doc_id IS NOT NULL) <= 10, false) AS ev_at_10 FROM ranked r LEFT JOIN ev e ON e.item_id = r.item_id AND e.doc_id = r.doc_id GROUP BY 1""")
def evidence_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    return A.evidence_recall(ranked, _evidence(spark, sf_dir, ranked), [1, 5, 10])


@query(f"""WITH {RANKED_SQL}, q AS (SELECT r.item_id, r.item_id % 4 AS category, coalesce(min(rank) FILTER (e.doc_id IS NOT NULL) <= 5, false) AS hit
  FROM ranked r LEFT JOIN ev e ON e.item_id = r.item_id AND e.doc_id = r.doc_id GROUP BY ALL)
SELECT coalesce(category::VARCHAR, 'all') AS category, count(*) AS questions, round(avg(hit::INT), 6) AS recall FROM q GROUP BY ROLLUP (category)""")
def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    found = A.evidence_recall(ranked, _evidence(spark, sf_dir, ranked), [5]).withColumn("category", F.col("question_id") % 4)
    out = found.rollup("category").agg(F.count("*").alias("questions"), F.round(F.avg(F.col("ev_at_5").cast("int")), 6).alias("recall"))
    return out.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("all")))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, n AS milestone FROM n WHERE n IN (10, 50, 100) OR n % 250 = 0""")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, sf_dir, "events").withColumn("milestone", A.milestone(n.cast("long")))
    return e.filter("milestone IS NOT NULL").select("user_id", "event_id", "milestone")


@query("""SELECT user_id, CASE WHEN count(*) <= 25 THEN 'full' WHEN count(*) <= 100 THEN 'conditional' ELSE 'silent' END AS tier FROM events GROUP BY 1""")
def attribution_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", A.attribution_tier(F.col("n")).alias("tier"))


@query("""SELECT conv_id, count(*) AS turns, sha256(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS sha256 FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def render_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exports.render(table(spark, sf_dir, "conversations"))
    return done.select("conv_id", "turns", F.sha2("text", 256).alias("sha256"))


@query("""WITH c AS (SELECT conv_id, min(turn) AS a, max(turn) AS b, count(*) AS n FROM conversations GROUP BY 1)
SELECT count(*) AS conversations, sum(n)::BIGINT AS messages, min(TIMESTAMP '2024-01-01' + to_minutes((conv_id + a)::INT)) AS earliest, max(TIMESTAMP '2024-01-01' + to_minutes((conv_id + b)::INT)) AS latest FROM c""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(conv_id + turn AS INT), 0)")
    return exports.summary(table(spark, sf_dir, "conversations").select("conv_id", at.alias("created_at")))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END AS parent FROM conversations),
w AS (SELECT conv_id, max(turn) AS turn, 0 AS depth FROM m GROUP BY 1 UNION ALL SELECT w.conv_id, m.parent, depth + 1 FROM w JOIN m USING (conv_id, turn) WHERE m.parent >= 0)
SELECT conv_id, turn, (max(depth) OVER (PARTITION BY conv_id) - depth)::BIGINT AS position FROM w WHERE EXISTS (SELECT 1 FROM m WHERE m.conv_id = w.conv_id AND m.turn = w.turn)""")
def export_active_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") % 3 == 2, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    nodes = c.select("conv_id", F.col("turn").alias("node"), parent.alias("parent"), F.lit(None).cast("double").alias("at"))
    heads = c.groupBy("conv_id").agg(F.max("turn").alias("node"))
    return exports.active_branch(nodes, heads).select("conv_id", F.col("node").alias("turn"), "position")
