"""Queries of the tools that agents call: neighbours, the context pack, provenance, review, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import STOP_WORDS
from loomspark.operators import analytics as A
from loomspark.operators import curation as C
from loomspark.operators import evidence as E
from loomspark.operators import graph as G
from loomspark.operators import neighbors as N
from loomspark.operators import pack as P
from loomspark.operators import provenance as W
from loomspark.operators import ranking as R
from loomspark.plans.evidence import NOISY
from loomspark.plans.graph import CANON_SQL, edges
from loomspark.plans.retrieval import HYBRID_SQL, Q_SQL, STOP_SQL, VEC
from loomspark.plans.views import DOCS_SQL, EDGES_SQL, TOKENS, docs, observations, query_text, query_vector, vectors
from loomspark.registry import query, table
from loomspark.sources import exports

AS_OF = "1999-01-01 00:00:00"
MEMORY_SQL = f"""documents_ AS (SELECT o_orderkey AS doc_id, (o_custkey % 10)::VARCHAR AS agent, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 2 END AS sharing, o_orderdate AS created_at FROM orders),
seen AS (SELECT * FROM documents_ WHERE sharing <> 1 OR agent = '3'),
dd AS (SELECT o_orderkey AS edge_id, o_orderkey AS one, o_orderkey + 1 AS two, (o_orderkey % 3)::VARCHAR AS rt, o_orderkey % 4 AS pr, 0.5::DOUBLE + (o_orderkey % 10) / 20.0::DOUBLE AS confidence, o_orderdate AS created_at FROM orders WHERE o_orderkey % 5 = 0),
dp AS (SELECT o_orderkey AS edge_id, o_custkey AS person, o_orderkey AS doc, '1' AS rt, 1.0::DOUBLE AS confidence, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderdate + INTERVAL 400 DAY > TIMESTAMP '{AS_OF}'),
mn AS (SELECT l_orderkey * 10 + l_linenumber AS edge_id, l_partkey AS entity, l_orderkey AS doc, round(1 - l_discount, 6) AS confidence, l_shipdate AS created_at FROM lineitem),
ee AS (SELECT p_partkey AS edge_id, p_partkey AS one, p_partkey + 1 AS two, 'near' AS predicate, 0.7::DOUBLE AS confidence, TIMESTAMP '1998-01-01 00:00:00' AS created_at FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 8 <> 0),
pp AS (SELECT c_custkey AS edge_id, c_custkey AS one, c_custkey + c_custkey % 2 AS two, '2' AS rt, 0.6::DOUBLE AS confidence, TIMESTAMP '1998-01-01 00:00:00' AS created_at FROM customer WHERE c_custkey % 3 = 0),
am AS (SELECT event_id AS edge_id, user_id % 10 AS source, event_id AS target, 'saved_memory' AS predicate, 1.0::DOUBLE AS confidence, ts AS created_at FROM events WHERE event_type = 'purchase'),
aa AS (SELECT event_id AS edge_id, user_id % 10 AS source, user_id % 7 AS target, 'recalled_memory' AS predicate, 1.0::DOUBLE AS confidence, ts AS created_at FROM events WHERE event_type = 'view')"""


def _branch(name: str, kinds: tuple[str, str], source: str, root: str, ends: tuple[str, str], predicate: str = "NULL", rt: str = "NULL", priority: str = "NULL", where: str = "true") -> str:
    return (
        f"SELECT '{name}' AS branch, '{kinds[0]}' AS root_kind, {root}::VARCHAR AS root, edge_id::VARCHAR AS edge_id, '{kinds[0]}' AS from_kind, {ends[0]}::VARCHAR AS from_id, '{kinds[1]}' AS to_kind, "
        f"{ends[1]}::VARCHAR AS to_id, {predicate} AS predicate, {rt} AS relation_type, confidence, created_at, {priority} AS pr FROM {source} WHERE {where}"
    )


def _both(name: str, kind: str, source: str, one: str, two: str, **more: str) -> str:
    return _branch(name, (kind, kind), source, one, (one, two), **more) + " UNION ALL " + _branch(name, (kind, kind), source, two, (one, two), where=f"{one} <> {two}", **more)


NEIGHBORS_SQL = " UNION ALL ".join([
    _both("doc_doc", "doc", "dd", "one", "two", rt="rt", priority="pr"), _branch("doc_person", ("doc", "person"), "dp", "doc", ("doc", "person"), rt="rt"),
    _branch("doc_entity", ("doc", "entity"), "mn", "doc", ("doc", "entity"), "'mentions'"), _both("entity_entity", "entity", "ee", "one", "two", predicate="predicate"),
    _branch("entity_doc", ("entity", "doc"), "(SELECT * FROM mn WHERE doc IN (SELECT doc_id FROM seen))", "entity", ("entity", "doc"), "'mentioned_in'"),
    _branch("agent_doc", ("agent", "doc"), "(SELECT doc_id AS edge_id, agent, doc_id, 1.0::DOUBLE AS confidence, created_at FROM seen)", "agent", ("agent", "doc_id"), "'owns_memory'"),
    _branch("agent_memory", ("agent", "doc"), "am", "source", ("source", "target"), "predicate"), _both("agent_agent", "agent", "aa", "source", "target", predicate="predicate"),
    _branch("person_doc", ("person", "doc"), "dp", "person", ("person", "doc"), rt="rt"), _both("person_person", "person", "pp", "one", "two", rt="rt"),
])


def _memory(spark: SparkSession, sf_dir: str) -> N.Memory:
    o, item, e = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events")
    key, old = F.col("o_orderkey"), F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    none = F.lit(None).cast("timestamp_ntz")
    documents = o.select(key.alias("doc_id"), (F.col("o_custkey") % 10).cast("string").alias("agent"), F.when(key % 7 == 0, 1).otherwise(2).alias("sharing"), F.col("o_orderdate").alias("created_at"))
    related = o.filter(key % 5 == 0).select(
        key.alias("edge_id"), key.alias("doc1"), (key + 1).alias("doc2"), (key % 3).alias("relation_type"), (key % 4).cast("int").alias("priority"),
        (0.5 + (key % 10) / 20.0).alias("confidence"), F.col("o_orderdate").alias("created_at"),
    )
    people = o.select(
        key.alias("edge_id"), F.col("o_custkey").alias("person"), key.alias("doc"), F.lit(1).alias("relation_type"), F.lit(1.0).alias("confidence"), F.col("o_orderdate").alias("created_at"),
        F.when(key % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).cast("timestamp_ntz").alias("valid_to"),
    )
    mentions = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("doc"), F.round(1 - F.col("l_discount"), 6).alias("confidence"), F.col("l_shipdate").alias("created_at"))
    p, c = F.col("p_partkey"), F.col("c_custkey")
    near = table(spark, sf_dir, "part").filter(p % 4 == 0).select(
        p.alias("edge_id"), p.alias("entity1"), (p + 1).alias("entity2"), F.lit("near").alias("predicate"), F.lit(0.7).alias("confidence"), old.alias("created_at"), F.when(p % 8 == 0, old).otherwise(none).alias("valid_to")
    )
    folk = table(spark, sf_dir, "customer").filter(c % 3 == 0).select(
        c.alias("edge_id"), c.alias("person1"), (c + c % 2).alias("person2"), F.lit(2).alias("relation_type"), F.lit(0.6).alias("confidence"), old.alias("created_at"), none.alias("end_date")
    )
    told = lambda type, kind, target, predicate: e.filter(F.col("event_type") == type).select(
        "event_id", F.lit(kind).alias("kind"), (F.col("user_id") % 10).alias("source"), target.alias("target"), F.lit(predicate).alias("predicate"), F.lit(1.0).alias("confidence"), F.col("ts").alias("created_at")
    )
    evidence = told("purchase", "agent_memory", F.col("event_id"), "saved_memory").unionByName(told("view", "agent_agent", F.col("user_id") % 7, "recalled_memory"))
    return N.Memory(documents, related, people, mentions, near, folk, evidence.withColumnRenamed("event_id", "edge_id"))


@query(f"""WITH {MEMORY_SQL}, every AS ({NEIGHBORS_SQL}), roots AS (SELECT 'doc' AS root_kind, o_orderkey::VARCHAR AS root FROM orders UNION SELECT 'entity', p_partkey::VARCHAR FROM part
  UNION SELECT 'agent', n::VARCHAR FROM range(10) t(n) UNION SELECT 'person', c_custkey::VARCHAR FROM customer)
SELECT branch, root_kind, root, edge_id, from_kind, from_id, to_kind, to_id, predicate, relation_type, confidence FROM (SELECT every.*, row_number() OVER (PARTITION BY branch, root_kind, root
  ORDER BY pr DESC NULLS LAST, CASE WHEN branch = 'doc_doc' THEN confidence END DESC NULLS LAST, created_at DESC, edge_id) AS r FROM every JOIN roots USING (root_kind, root)) WHERE r <= 3""")
def neighbors_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbours a branch of every order, part, customer and agent."""
    root = lambda name, kind, id: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"))
    roots = root("orders", "doc", "o_orderkey").unionByName(root("part", "entity", "p_partkey")).unionByName(root("customer", "person", "c_custkey"))
    roots = roots.unionByName(spark.range(10).select(F.lit("agent").alias("kind"), F.col("id").cast("string").alias("id")))
    return N.neighbors(_memory(spark, sf_dir), roots, F.expr(f"timestamp_ntz'{AS_OF}'"), "3", 3).drop("created_at")


@query(f"""WITH {CANON_SQL}, h AS (SELECT doc_id, text, lang, 1.0::DOUBLE / (1 + doc_id) AS score, TIMESTAMP '2024-01-01 00:00:00' AS created_at, row_number() OVER (ORDER BY doc_id) AS rank FROM documents ORDER BY doc_id LIMIT 12),
c AS (SELECT *, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM h), u AS (SELECT *, sum(tokens) OVER (ORDER BY rank) AS upto FROM c), packed AS (SELECT * FROM u WHERE upto <= 3000 OR rank = 1),
ent AS (SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS rank, * FROM (SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR p_brand = 'ring' ORDER BY p_name, p_partkey LIMIT 10)),
folk AS (SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS rank, * FROM (SELECT c_custkey, c_name, lower(replace(c_name, '#', '.')) || '@ring.example' AS email FROM customer ORDER BY c_name, c_custkey LIMIT 10)),
note AS (SELECT row_number() OVER (ORDER BY turn DESC, note_id) AS rank, * FROM (SELECT conv_id * 1000 + turn AS note_id, turn, text FROM conversations WHERE role = 'user' AND contains(lower(text), 'ring') ORDER BY turn DESC, note_id LIMIT 5)),
seeds AS (SELECT 'doc' AS k, doc_id AS i FROM packed UNION ALL SELECT 'part', p_partkey FROM ent WHERE false UNION ALL SELECT 'person', c_custkey FROM folk),
near AS (SELECT row_number() OVER (ORDER BY confidence DESC, kind, src, dst, predicate) AS rank, * FROM (SELECT DISTINCT kind, src_kind, src, dst_kind, dst, predicate, confidence FROM canon
  WHERE (src_kind, src) IN (SELECT k, i FROM seeds) OR (dst_kind, dst) IN (SELECT k, i FROM seeds) ORDER BY confidence DESC, kind, src, dst, predicate LIMIT 20)),
ty AS (SELECT lang, count(*) AS n, sum(score) AS s FROM packed GROUP BY lang)
SELECT 'document' AS section, rank, doc_id::VARCHAR AS id, left(CASE WHEN upto > 3000 THEN left(text, 11999) || '…' ELSE text END, 40) AS name, '{{"tokens":' || CASE WHEN upto > 3000 THEN 3000 ELSE tokens END || ',"truncated":' || (upto > 3000) || '}}' AS detail FROM packed
UNION ALL SELECT 'entity', rank, p_partkey::VARCHAR, p_name, '{{"aliases":["' || p_brand || '"]}}' FROM ent UNION ALL SELECT 'person', rank, c_custkey::VARCHAR, c_name, '{{"email":"' || email || '"}}' FROM folk
UNION ALL SELECT 'note', rank, note_id::VARCHAR, left(text, 40), '{{"agent":"user"}}' FROM note
UNION ALL SELECT 'relation', rank, src_kind || ':' || src, predicate, '{{"kind":"' || kind || '","to":"' || dst_kind || ':' || dst || '"}}' FROM near
UNION ALL SELECT 'metadata', 1, NULL, NULL, '{{"hits":' || sum(n) || ',"documents":' || sum(n) || ',"by_type":"' || string_agg(lang || ':' || n, ',' ORDER BY lang || ':' || n) || '"}}' FROM ty
UNION ALL SELECT 'envelope', 1, NULL, sum(n) || ' facts used. Ask "why" to see sources.', '{{"mode":"audit","fact_count":' || sum(n) || ',"confidence_band":"' || CASE WHEN sum(s) / sum(n) >= 0.8 THEN 'high' WHEN sum(s) / sum(n) >= 0.5 THEN 'medium' ELSE 'low' END
  || '","source_type_count":' || count(*) || ',"source_types":{{' || string_agg('"' || lang || '":' || n, ',' ORDER BY lang) || '}}}}' FROM ty""")
def context_pack_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sections for the phrase "ring": parts are entities with their brand as alias, customers people, turns notes."""
    d = table(spark, sf_dir, "documents").orderBy("doc_id").limit(12)
    hits = d.select("doc_id", "text", F.col("lang").alias("type"), (1.0 / (1 + F.col("doc_id"))).alias("score"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("created_at"), F.expr("row_number() OVER (ORDER BY doc_id)").alias("rank"))
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    email = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@ring.example"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), email.alias("email"))
    notes = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.col("role").alias("agent"), F.col("text").alias("content"), F.col("turn").alias("created_at"))
    return P.pack(hits, entities, people, notes, edges(spark, sf_dir), "ring", "user", 3000, "audit")


WHY_SQL = f"""{EDGES_SQL}, l AS (SELECT *, CASE WHEN lag(object) OVER w IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS interval FROM l),
heads AS (SELECT subject, object, interval, min(observed_at) AS valid_from FROM runs GROUP BY subject, object, interval),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject ORDER BY interval) AS valid_to FROM heads)"""


@query(f"""WITH {WHY_SQL}, m AS (SELECT user_id::VARCHAR AS e, epoch_us(date_trunc('day', ts)) // 86400000000 AS d FROM events UNION ALL SELECT event_type, epoch_us(date_trunc('day', ts)) // 86400000000 FROM events),
n AS (SELECT e, d, count(*) AS n FROM m GROUP BY ALL), ask AS (SELECT DISTINCT user_id::VARCHAR AS a, 'purchase' AS b FROM events)
SELECT a, b, CASE WHEN valid_to IS NULL THEN 'direct' ELSE 'superseded' END AS section, 'did' AS predicate, valid_from, valid_to, NULL AS doc_id, NULL AS n_a, NULL AS n_b FROM ask JOIN spans ON subject::VARCHAR = a AND object = b
UNION ALL SELECT a, b, 'shared', NULL, NULL, NULL, x.d, x.n, y.n FROM ask JOIN n x ON x.e = a JOIN n y ON y.e = b AND y.d = x.d""")
def why_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with the type "purchase": edges now and before, and the days that mention both."""
    seen = observations(spark, sf_dir)
    spans = E.intervals(seen).select(F.col("subject").cast("string").alias("subject"), "object", "predicate", "confidence", "valid_from", "valid_to")
    day = F.unix_date(F.to_date("observed_at")).cast("long").alias("doc_id")
    mentions = seen.select(F.col("subject").cast("string").alias("entity_id"), day).unionByName(seen.select(F.col("object").alias("entity_id"), day))
    asked = seen.select(F.col("subject").cast("string").alias("a"), F.lit("purchase").alias("b"))
    return W.pairs(asked, spans, mentions).drop("confidence")


@query("""WITH doc AS (SELECT o_custkey AS id, o_orderkey AS doc_id, o_orderdate AS made, o_orderpriority AS source, o_orderstatus AS state FROM orders),
pr AS (SELECT 'entity' AS kind, l_orderkey * 10 + l_linenumber AS proposal_id, CASE WHEN l_linenumber > 3 THEN 'pending' ELSE 'approved' END AS state, l_orderkey AS doc_id FROM lineitem WHERE l_linenumber % 2 = 1
  UNION ALL SELECT 'relation', l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber > 3 THEN 'pending' ELSE 'approved' END, l_orderkey FROM lineitem WHERE l_linenumber % 2 = 0)
SELECT c_custkey AS id, 'subject' AS section, NULL::TIMESTAMP AS made, c_name AS detail FROM customer UNION ALL SELECT user_id, 'trail', ts, event_type || ' ' || event_id FROM events JOIN customer ON c_custkey = user_id
UNION ALL SELECT id, 'ingest', made, doc_id || ' ' || source || ' ' || state FROM doc JOIN customer ON c_custkey = id UNION ALL SELECT id, 'proposal', NULL, kind || ' ' || proposal_id || ' ' || pr.state FROM doc JOIN customer ON c_custkey = id JOIN pr USING (doc_id)
UNION ALL SELECT user_id, 'evidence', ts, 'source knows ' || (user_id + 1) % 50 FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'signup'
UNION ALL SELECT (user_id + 1) % 50, 'evidence', ts, 'target knows ' || user_id FROM events JOIN customer ON c_custkey = (user_id + 1) % 50 WHERE event_type = 'signup' AND user_id <> (user_id + 1) % 50""")
def why_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of where each customer comes from."""
    c, o, item, e = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "events"))
    proposal = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("proposal_id")
    state = F.when(F.col("l_linenumber") > 3, "pending").otherwise("approved").alias("state")
    sure, doc = F.lit(0.5).alias("confidence"), F.col("l_orderkey").alias("doc_id")
    ents = item.filter("l_linenumber % 2 = 1").select(proposal, F.lit("n").alias("name"), state, sure, doc)
    rels = item.filter("l_linenumber % 2 = 0").select(proposal, F.col("l_suppkey").alias("subject"), F.lit("of").alias("predicate"), F.col("l_partkey").alias("object"), state, sure, doc)
    documents = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("state"))
    trail = e.select(F.col("user_id").alias("id"), F.col("ts").alias("at"), F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("change"))
    knows = e.filter("event_type = 'signup'").select(F.col("user_id").alias("source"), ((F.col("user_id") + 1) % 50).alias("target"), F.lit("knows").alias("predicate"), F.col("ts").alias("at"))
    asked = c.select(F.col("c_custkey").cast("long").alias("id"))
    named = c.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    return W.subjects(asked, named, trail, W.proposals_of(ents, rels), documents, knows).withColumnRenamed("at", "made")


def _relation_proposals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Purchases as approved relations between users and types, seen in their day; other events are the evidence there is."""
    seen = observations(spark, sf_dir)
    spo = ["subject", "predicate", "object"]
    approved = seen.filter("event_id % 4 = 0").select(F.col("event_id").alias("proposal_id"), *spo, F.lit("approved").alias("state"), F.col("source").alias("doc_id"), "confidence")
    evidence = seen.filter("event_id % 4 <> 0").select(*spo, "source", "confidence")
    outcomes = approved.select("proposal_id", *spo, F.when(F.col("proposal_id") % 3 == 0, "blocked").otherwise("kept").alias("outcome"))
    return approved, outcomes, evidence


@query(f"""WITH {EDGES_SQL}, old AS (SELECT subject, predicate, object, source, confidence FROM obs WHERE event_id % 4 <> 0),
ap AS (SELECT subject, predicate, object, source, max(confidence) AS confidence FROM obs WHERE event_id % 4 = 0 AND event_id % 3 <> 0 GROUP BY ALL),
fresh AS (SELECT * FROM ap WHERE NOT EXISTS (SELECT 1 FROM old WHERE (old.subject, old.object, old.source) = (ap.subject, ap.object, ap.source))),
every AS (SELECT * FROM old WHERE (subject, object) IN (SELECT subject, object FROM fresh) UNION ALL SELECT * FROM fresh),
ps AS (SELECT subject, predicate, object, source, max(confidence) AS confidence FROM every GROUP BY ALL),
agg AS (SELECT subject, predicate, object, count(*) AS sources, max(confidence) AS m, product(1 - 0.4::DOUBLE * confidence) AS p FROM ps WHERE confidence > 0 GROUP BY ALL)
SELECT subject, predicate, object, sources, round({NOISY}, 6) AS confidence FROM agg""")
def review_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.evidence_of_approved(*_relation_proposals(spark, sf_dir))[1]


@query("""WITH p AS (SELECT p_partkey AS proposal_id, p_brand AS name, p_type AS kind, p_retailprice / 2000 AS confidence, p_partkey % 500 AS doc_id FROM part WHERE p_size % 2 = 0),
e AS (SELECT lower(p_brand) AS n, p_type AS k, min(p_partkey) AS id FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL),
r AS (SELECT proposal_id, coalesce(e.id::VARCHAR, sha256(kind || chr(10) || lower(name))) AS entity_id, doc_id, least(greatest(confidence, 0), 1) AS confidence FROM p LEFT JOIN e ON e.n = lower(p.name) AND e.k = p.kind)
SELECT entity_id, doc_id, max(confidence) AS confidence FROM r WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey::VARCHAR = r.entity_id AND l_orderkey = r.doc_id) GROUP BY ALL""")
def review_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("proposal_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.lit("approved").alias("state"), (F.col("p_retailprice") / 2000).alias("confidence"), (F.col("p_partkey") % 500).alias("doc_id"))
    entities = p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("entity_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    return C.mentions_of_approved(rows, C.approved_entities(rows, entities), mentions)


@query("""SELECT p_partkey AS proposal_id, p_name AS name, r_name AS kind, round(p_retailprice / 2000, 2) AS confidence, left(text, 20) AS source FROM part LEFT JOIN region ON r_regionkey = p_size % 7
LEFT JOIN documents ON doc_id = p_partkey * 3 WHERE p_size > 10 ORDER BY p_retailprice / 2000 DESC, p_partkey LIMIT 50""")
def review_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("proposal_id"), F.col("p_name").alias("name"), (F.col("p_size") % 7).alias("kind_id"), (F.col("p_retailprice") / 2000).alias("confidence"),
                    F.when(F.col("p_size") > 10, "pending").otherwise("approved").alias("state"), (F.col("p_partkey") * 3).alias("doc_id"))
    kinds = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("kind_id"), F.col("r_name").alias("name"))
    return C.pending_list(rows, kinds, table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(20)).alias("name")))


@query("""WITH g AS (SELECT o_orderpriority AS kind, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 5 = 0 THEN 'reversed' ELSE 'correct' END AS v FROM orders),
c AS (SELECT kind, count(*) AS total, count(*) FILTER (v = 'correct') AS correct, count(*) FILTER (v = 'reversed') AS reversed, count(*) FILTER (v = 'missing') AS missing FROM g GROUP BY kind)
SELECT *, round(correct / total, 6) AS accuracy, round((reversed + missing) / total, 6) AS error_rate, round(correct / (correct + reversed), 6) AS precision FROM c""")
def direction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expected relations of customer and clerk, found as they are, turned round, or not at all."""
    key = F.col("o_orderkey")
    one, two = F.concat(F.lit("Buyer person"), F.col("o_custkey").cast("string")), F.concat(F.lit("the clerk"), key.cast("string"), F.lit(" Agency"))
    expected = table(spark, sf_dir, "orders").select(key.alias("case_id"), F.lit(1).alias("relation_id"), one.alias("subject"), two.alias("object"), "o_orderpriority")
    turned = key % 5 == 0
    short_one, short_two = F.concat(F.lit("person"), F.col("o_custkey").cast("string")), F.concat(F.lit("clerk"), key.cast("string"))
    found = table(spark, sf_dir, "orders").filter(key % 11 != 0).select(key.alias("case_id"), F.when(turned, short_two).otherwise(short_one).alias("subject"), F.when(turned, short_one).otherwise(short_two).alias("object"))
    judged = A.directions(expected.drop("o_orderpriority"), found).join(expected.select("case_id", F.col("o_orderpriority").alias("kind")), "case_id")
    return A.direction_summary(judged, ["kind"])


@query("""WITH c AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS got FROM events GROUP BY user_id), s AS (SELECT c_custkey AS id, 'seg' || c_custkey % 5 AS category,
  CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' ELSE 'view' END AS expected FROM customer),
r AS (SELECT s.*, coalesce(got, 'none') AS got FROM s LEFT JOIN c ON user_id = id)
SELECT category, count(*) AS n, count(*) FILTER (got = expected) AS correct, count(*) FILTER (got <> expected AND (got = 'purchase' OR expected = 'none')) AS misuses,
  round(100.0::DOUBLE * count(*) FILTER (got = expected) / count(*), 1) AS percent FROM r GROUP BY ROLLUP (category)""")
def routing_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenarios with a tool that is right for them, their events as the calls that were made."""
    c = F.col("c_custkey")
    expected = F.when(c % 4 == 0, "none").when(c % 4 == 1, "click").when(c % 4 == 2, "purchase").otherwise("view")
    scenarios = table(spark, sf_dir, "customer").select(c.cast("long").alias("scenario_id"), F.concat(F.lit("seg"), (c % 5).cast("string")).alias("category"), expected.alias("expected"))
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("scenario_id"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("tool"))
    return A.adherence(scenarios, calls, misused="purchase")


@query(r"""WITH d AS (SELECT conv_id AS q, turn + 1 AS rank, text FROM conversations), a AS (SELECT conv_id AS q, string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ')[1] AS answer FROM conversations WHERE turn = 1),
f AS (SELECT q, rank, text, contains(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), trim(regexp_replace(regexp_replace(lower(answer), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g'))) AS within FROM a LEFT JOIN d USING (q))
SELECT q AS question_id, coalesce(min(rank) FILTER (within) <= 1, false) AS r_at_1, coalesce(min(rank) FILTER (within) <= 3, false) AS r_at_3, coalesce(bool_or(within) FILTER (rank = 1), false) AS exact FROM f GROUP BY q""")
def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as hits of their conversation, its second turn's first word as the answer."""
    c = table(spark, sf_dir, "conversations")
    ranked = c.select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), "text")
    answers = c.filter("turn = 1").select(F.col("conv_id").alias("question_id"), F.split(F.trim("text"), r"\s+")[0].alias("answer"))
    return A.retrieval_quality(ranked, answers, [1, 3]).drop("f1")


EVAL_TOKENS = f"list_filter({TOKENS}, lambda w: w NOT IN ({STOP_SQL}))"


@query(f"""WITH {DOCS_SQL}, {Q_SQL}, qt AS (SELECT unnest({EVAL_TOKENS.format("text")}) AS term FROM benchmark WHERE item_id = 3),
cand AS (SELECT d.*, round(list_cosine_similarity({VEC.format("v.embedding")}, q.e), 6) AS sim FROM docs d JOIN embeddings v ON d.doc_id = v.vec_id, q ORDER BY sim DESC, d.doc_id LIMIT 30),
tok AS (SELECT doc_id, unnest({EVAL_TOKENS.format("text")}) AS term FROM cand), n AS (SELECT c.doc_id, count(t.term) AS n FROM cand c LEFT JOIN tok t USING (doc_id) GROUP BY c.doc_id),
stat AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM n), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, count(*) AS w FROM qt GROUP BY term),
p AS (SELECT f.doc_id, sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n.n / avg_len))) AS s, count(*) AS met
  FROM tf f JOIN w USING (term) JOIN df USING (term) JOIN n USING (doc_id), stat GROUP BY f.doc_id),
b AS (SELECT c.doc_id, c.sim, round(coalesce(s, 0), 6) AS bm25, coalesce(met, 0) AS met FROM cand c LEFT JOIN p USING (doc_id)),
m AS (SELECT *, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 0::DOUBLE ELSE round((bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()), 6) END AS text_score,
  CASE WHEN max(sim) OVER () = min(sim) OVER () THEN 0::DOUBLE ELSE round((sim - min(sim) OVER ()) / (max(sim) OVER () - min(sim) OVER ()), 6) END AS vector_score, row_number() OVER (ORDER BY met DESC, sim DESC, doc_id) - 1 AS place FROM b),
f AS (SELECT *, CASE WHEN place < 3 THEN round(0.15::DOUBLE * (1 - place / 3), 6) ELSE 0 END::DOUBLE AS boost FROM m)
SELECT doc_id, vector_score, text_score, boost, round(0.6::DOUBLE * vector_score + 0.4::DOUBLE * text_score + boost, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid_eval(docs(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), 10, STOP_WORDS)
    return found.select("doc_id", "vector_score", "text_score", "boost", "score")


@query(f"""WITH {HYBRID_SQL}, r AS (SELECT doc_id, score, round(0.7::DOUBLE * score + 0.3::DOUBLE * (1 - (row_number() OVER (ORDER BY created_at DESC, doc_id) - 1) / count(*) OVER ()), 6) AS reranked FROM hyb)
SELECT * FROM r ORDER BY reranked DESC, doc_id LIMIT 5""")
def temporal_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = lambda n: R.hybrid(docs(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), n)
    return R.temporal(search, 5).select("doc_id", "score", "reranked")


@query(f"""WITH {CANON_SQL}, both_ AS (SELECT kind, src AS root, dst_kind AS other_kind, dst AS other, 'out' AS direction, predicate, confidence FROM canon WHERE src_kind = 'doc'
  UNION ALL SELECT kind, dst, src_kind, src, 'in', predicate, confidence FROM canon WHERE dst_kind = 'doc')
SELECT root, other_kind, other, direction, predicate, confidence FROM both_ WHERE confidence >= 0.93 AND other_kind = 'part' AND predicate IN ('contains', 'ordered') AND root IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def related_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.lit("doc").alias("kind"), F.col("o_orderkey").alias("id"))
    found = G.related(edges(spark, sf_dir), seeds, "both", 0.93, ["part"], ["contains", "ordered"])
    return found.select("root", "other_kind", "other", "direction", "predicate", "confidence")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn AS node, CASE WHEN turn % 3 = 2 THEN turn - 2 WHEN turn > 0 THEN turn - 1 END AS parent, length(text) AS made FROM conversations),
h AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN -1 ELSE max(node) END AS node FROM n GROUP BY conv_id),
w AS (SELECT h.conv_id, h.node, 0 AS back FROM h WHERE conv_id % 3 <> 0 UNION ALL SELECT w.conv_id, n.parent, back + 1 FROM w JOIN n USING (conv_id, node) WHERE n.parent IS NOT NULL)
SELECT conv_id, node, (max(back) OVER (PARTITION BY conv_id) - back)::BIGINT AS position FROM w WHERE EXISTS (SELECT 1 FROM n WHERE n.conv_id = w.conv_id AND n.node = w.node)
UNION ALL SELECT conv_id, node, row_number() OVER (PARTITION BY conv_id ORDER BY made, node) - 1 FROM n WHERE conv_id % 3 = 0""")
def export_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trees; every third names a head that is not there."""
    turn, c = F.col("turn"), table(spark, sf_dir, "conversations")
    parent = F.when(turn % 3 == 2, turn - 2).when(turn > 0, turn - 1)
    nodes = c.select("conv_id", turn.alias("node"), parent.alias("parent"), F.length("text").alias("at"))
    heads = c.groupBy("conv_id").agg(F.max("turn").alias("node")).withColumn("node", F.when(F.col("conv_id") % 3 == 0, -1).otherwise(F.col("node")))
    return exports.active_messages(nodes, heads)


@query("""WITH t AS (SELECT conv_id, turn, upper(role[1]) || role[2:] || CASE WHEN turn % 2 = 0 THEN ' (' || strftime(TIMESTAMP '2024-01-01' + to_minutes(turn::INT), '%Y-%m-%dT%H:%M:%S.000Z') || ')' ELSE '' END || ':' || chr(10) || text AS said
  FROM conversations WHERE trim(text) <> '')
SELECT conv_id, sha256(trim('Chat Conversation: talk ' || conv_id || chr(10) || 'Conversation ID: ' || conv_id || chr(10) || 'Created: 2024-01-01T00:00:00.000Z' || chr(10) || chr(10) || string_agg(said, chr(10) || chr(10) ORDER BY turn))) AS sha256 FROM t GROUP BY conv_id""")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    first = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    at = F.when(F.col("turn") % 2 == 0, first + F.make_dt_interval(mins=F.col("turn").cast("int")))
    about = c.select("conv_id").distinct().select("conv_id", F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title"), first.alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    shown = exports.render_export(c.select("conv_id", F.col("turn").alias("position"), "role", "text", at.alias("at")), about, "Chat")
    return shown.select("conv_id", F.sha2("text", 256).alias("sha256"))


@query("""WITH p AS (SELECT event_id, event_type AS workspace, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE 'thing' END AS kind, round(least(greatest(value / 100, 0), 1), 6) AS confidence FROM events)
SELECT event_id, CASE workspace WHEN 'purchase' THEN 0.9 WHEN 'click' THEN 0.25 ELSE 0.6 END::DOUBLE AS threshold,
  CASE WHEN kind = 'thing' AND confidence >= CASE workspace WHEN 'purchase' THEN 0.9 WHEN 'click' THEN 0.25 ELSE 0.6 END THEN 'promoted' ELSE 'pending' END AS state FROM p""")
def promote_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = observations(spark, sf_dir).select("event_id", F.col("object").alias("workspace"), F.when(F.col("subject") % 3 == 0, "unknown").otherwise("thing").alias("kind"), "confidence")
    settings = spark.createDataFrame([("purchase", "0.9"), ("click", " 0.25"), ("view", "7"), ("signup", "often")], "workspace string, least string")
    return C.promote_by_setting(p, spark.createDataFrame([("thing",)], "kind string"), settings).select("event_id", "threshold", "state")


@query("""WITH f AS (SELECT event_type AS workspace, 'agent:u' || user_id % 20 AS made_by, 'Thing ' || user_id AS name, 'k' || event_id % 3 AS entity_kind, round(least(greatest(value / 100, 0), 1), 6) AS confidence, event_id FROM events)
SELECT sha256('entity|' || workspace || '|' || made_by || '|' || name || '|' || entity_kind) AS proposal_id, 'entity' AS kind, max(confidence) AS confidence, 'pending' AS state FROM f WHERE event_id % 2 = 0 GROUP BY workspace, made_by, name, entity_kind
UNION ALL SELECT sha256('relation|' || workspace || '|' || made_by || '|' || name || '|likes|' || entity_kind), 'relation', max(confidence), 'pending' FROM f WHERE event_id % 2 = 1 AND event_id % 5 <> 0 GROUP BY workspace, made_by, name, entity_kind
UNION ALL SELECT NULL, 'rejected ' || 'predicate', NULL, count(*)::VARCHAR FROM f WHERE event_id % 2 = 1 AND event_id % 5 = 0""")
def propose_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, seen = F.col("event_id"), observations(spark, sf_dir)
    name, kind = F.concat(F.lit("Thing "), F.col("subject").cast("string")), F.concat(F.lit("k"), (id % 3).cast("string"))
    facts = seen.select(
        F.col("object").alias("workspace"), F.concat(F.lit("u"), (F.col("subject") % 20).cast("string")).alias("agent"), F.when(id % 2 == 0, "entity").otherwise("relation").alias("kind"),
        F.concat(name, F.lit(" ")).alias("name"), kind.alias("entity_kind"), F.array(F.lit("alias")).alias("aliases"), name.alias("subject"), F.when(id % 5 != 0, "Currently likes").alias("predicate"), kind.alias("object"), id.alias("doc_id"), "confidence",
    )
    entities, relations, rejected = C.proposed(facts)
    out = entities.select("proposal_id", F.lit("entity").alias("kind"), "confidence", "state").unionByName(relations.select("proposal_id", F.lit("relation").alias("kind"), "confidence", "state"))
    lost = rejected.groupBy("problem").agg(F.count("*").alias("n"))
    return out.unionByName(lost.select(F.lit(None).cast("string").alias("proposal_id"), F.concat(F.lit("rejected "), "problem").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.col("n").cast("string").alias("state")))


@query("""WITH n AS (SELECT DISTINCT kind, lower(name) AS name FROM (SELECT p_brand AS kind, p_name AS name FROM part UNION ALL SELECT p_brand, string_split(p_name, ' ')[1] FROM part WHERE p_size % 2 = 0)),
b AS (SELECT s.kind, s.name, arg_max(l.name, (length(l.name), l.name)) AS canonical FROM n s JOIN n l ON s.kind = l.kind AND (starts_with(l.name, s.name || ' ') OR suffix(l.name, ' ' || s.name)) GROUP BY ALL),
r AS (SELECT n.kind, n.name, coalesce(canonical, n.name) AS canonical FROM n LEFT JOIN b USING (kind, name))
SELECT kind, canonical, coalesce(string_agg(name, '|' ORDER BY name) FILTER (name <> canonical), '') AS aliases FROM r GROUP BY ALL""")
def entity_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_brand").alias("kind"), F.col("p_name").alias("name"))
    short = p.filter("p_size % 2 = 0").select(F.col("p_brand").alias("kind"), F.split("p_name", " ")[0].alias("name"))
    return C.aliases_of(C.resolve_names(names.unionByName(short))).select("kind", "canonical", F.array_join("aliases", "|").alias("aliases"))


@query("""WITH c AS (SELECT event_type AS path, max(ts) AS modified, CASE WHEN event_type IN ('purchase', 'click') THEN 'tree' END AS kind, count(*) FILTER (value > 20) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1)
SELECT path, format('{:,}', n) || ' Chat ' || CASE WHEN n = 1 THEN 'conversation' ELSE 'conversations' END || ' from ' || CASE WHEN strftime(a, '%b %Y') = strftime(b, '%b %Y') THEN strftime(a, '%b %Y') ELSE strftime(a, '%b %Y') || ' to ' || strftime(b, '%b %Y') END AS line
FROM c WHERE kind IS NOT NULL AND n > 0 ORDER BY modified DESC, path LIMIT 1""")
def export_offer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("path")).agg(F.max("ts").alias("modified"), F.count_if(F.col("value") > 20).alias("conversations"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    found = exports.newest(e.withColumn("kind", F.when(F.col("path").isin("purchase", "click"), "tree")))
    return found.select("path", exports.described(F.col("conversations"), "Chat", F.col("a"), F.col("b")).alias("line"))
