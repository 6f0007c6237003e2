"""Queries of the memory tools: search with all its options, recall, context, provenance, gating, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import analytics as A
from loomspark.operators import evidence as E
from loomspark.operators import extraction as X
from loomspark.operators import graph as G
from loomspark.operators import memory as M
from loomspark.operators import ranking as R
from loomspark.plans.graph import edges, seeds
from loomspark.plans.retrieval import BM25_SQL, Q_SQL, STOP_SQL, VEC
from loomspark.plans.views import DOCS_SQL, EDGES_SQL, TOKENS, docs, observations, query_text, query_vector, vectors
from loomspark.registry import query, table

FOUND_SQL = f"""{DOCS_SQL.replace("docs AS (", "every AS (")}, docs AS (SELECT * FROM every WHERE lang IN ('en', 'de') AND created_at >= TIMESTAMP '2024-01-02 00:00:00'
  AND doc_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')) AND doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey < 60)),
t AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS t FROM part WHERE p_partkey = 1),
e AS (SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(p_name), t.t)) ORDER BY length(p_name) DESC, p_partkey LIMIT 5),
r AS (SELECT p_partkey, [0.4::DOUBLE, 0.25, 0.15, 0.08, 0.04][row_number() OVER (ORDER BY length(p_name) DESC, p_partkey)] AS b FROM e),
boost AS (SELECT doc_id, round(sum(b), 6) AS boost FROM (SELECT DISTINCT l_partkey, l_orderkey AS doc_id FROM lineitem) JOIN r ON r.p_partkey = l_partkey GROUP BY doc_id)"""


@query(f"""WITH {FOUND_SQL}, {Q_SQL}, {BM25_SQL.format(k=30, qt=f"SELECT unnest({TOKENS.format('text')}) AS term FROM benchmark WHERE item_id = 3", p="")}
SELECT doc_id, created_at, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score + coalesce(boost, 0), 6) AS score FROM mm LEFT JOIN boost USING (doc_id)
ORDER BY created_at DESC, score DESC, doc_id LIMIT 8 OFFSET 2""")
def search_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters by type, time, person and entity, an entity boost inside the score, newest first, second page."""
    people = table(spark, sf_dir, "orders").filter("o_orderstatus IN ('F', 'O')").select(F.col("o_orderkey").alias("doc_id"))
    about = table(spark, sf_dir, "lineitem").filter("l_suppkey < 60").select(F.col("l_orderkey").alias("doc_id"))
    own = docs(spark, sf_dir).filter(F.col("lang").isin("en", "de") & (F.col("created_at") >= F.expr("timestamp_ntz'2024-01-02 00:00:00'")))
    own = own.join(people, "doc_id", "left_semi").join(about, "doc_id", "left_semi")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    boost = R.entity_boosts(parts, mentions, parts.filter("entity_id = 1").first()["name"])
    found = R.hybrid(own, vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), 8, 2, boost, sort="date_desc")
    return found.select("doc_id", "created_at", "score")


RECALL_SQL = f"""{DOCS_SQL}, own AS (SELECT * FROM docs WHERE workspace IN ('src1', 'src2', 'src3') AND lang = 'en'), {Q_SQL},
qw AS (SELECT DISTINCT unnest({TOKENS.format("text")}) AS term FROM benchmark WHERE item_id = 3), tok AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM own),
tf AS (SELECT doc_id, term, count(*) AS n FROM tok JOIN qw USING (term) GROUP BY ALL),
ft AS (SELECT doc_id, round(sum(n / (n + 1.0::DOUBLE)), 6) AS score FROM tf GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10),
nv AS (SELECT doc_id, round(list_cosine_similarity({VEC.format("embedding")}, q.e), 6) AS sim FROM embeddings JOIN own ON doc_id = vec_id, q ORDER BY sim DESC, doc_id LIMIT 10),
l AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM nv), w AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ft),
fused AS (SELECT coalesce(l.doc_id, w.doc_id) AS doc_id, round(coalesce(1::DOUBLE / (60 + l.r), 0) + coalesce(1::DOUBLE / (60 + w.r), 0), 6) AS score
  FROM l FULL OUTER JOIN w ON l.doc_id = w.doc_id ORDER BY score DESC, doc_id LIMIT 10),
rec AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused)"""


def _recall(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = docs(spark, sf_dir).filter("workspace IN ('src1', 'src2', 'src3')").withColumn("agent", F.col("lang"))
    return own, M.recall(own, vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), 10, agent="en")


@query(f"WITH {RECALL_SQL} SELECT * FROM rec")
def recall_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _recall(spark, sf_dir)[1]
    return found.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {RECALL_SQL}, h AS (SELECT rec.doc_id, rank, text, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM rec JOIN own USING (doc_id)),
c AS (SELECT *, sum(tokens) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM h), packed AS (SELECT * FROM c WHERE upto <= 2000 OR rank = 1),
ent AS (SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'green') OR contains(lower(p_name), 'ring') ORDER BY length(p_name) DESC, p_partkey LIMIT 5),
rel AS (SELECT l_orderkey AS doc_id, l_partkey, p_name, round(1 - l_discount, 6) AS confidence FROM lineitem JOIN part ON p_partkey = l_partkey
  WHERE l_orderkey IN (SELECT doc_id FROM packed) ORDER BY confidence DESC, doc_id, l_partkey LIMIT 5)
SELECT 'document' AS section, rank, doc_id::VARCHAR AS id, left(CASE WHEN upto > 2000 THEN left(text, 7999) || '…' ELSE text END, 40) AS name, CASE WHEN upto > 2000 THEN 2000 ELSE tokens END::BIGINT AS tokens FROM packed
UNION ALL SELECT 'entity', row_number() OVER (ORDER BY length(name) DESC, id), id::VARCHAR, name, NULL FROM ent
UNION ALL SELECT 'relation', row_number() OVER (ORDER BY confidence DESC, doc_id, l_partkey), l_partkey::VARCHAR, p_name, NULL FROM rel""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _recall(spark, sf_dir)
    hits = own.select("doc_id", "text").join(F.broadcast(found.select("doc_id", "rank")), "doc_id")  # ten rows
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id"), F.round(1 - F.col("l_discount"), 6).alias("confidence"))
    relations = items.join(parts, "entity_id").withColumnRenamed("entity_id", "relation_id")
    return M.context_pack(hits, parts, relations, "green ring", 2000)


@query(f"""WITH {DOCS_SQL}, {Q_SQL}, q1 AS (SELECT unnest({TOKENS.format("text")}) AS term FROM benchmark WHERE item_id = 3),
{BM25_SQL.format(k=45, qt="SELECT term FROM q1", p="")}, p1 AS (SELECT doc_id, text, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score, 6) AS score FROM mm ORDER BY score DESC, doc_id LIMIT 15),
best AS (SELECT * FROM p1 ORDER BY score DESC, doc_id LIMIT 5),
more AS (SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS.format("text")}) AS term FROM best) WHERE term NOT IN ({STOP_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 10),
{BM25_SQL.format(k=30, qt="SELECT term FROM q1 UNION ALL SELECT term FROM more", p="x")}, p2 AS (SELECT doc_id, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score, 6) AS score FROM mmx ORDER BY score DESC, doc_id LIMIT 10)
SELECT doc_id, max(score) AS score FROM (SELECT doc_id, score FROM p1 UNION ALL SELECT * FROM p2) GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 5""")
def prf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    search = lambda text, vector, limit: R.hybrid(docs(spark, sf_dir), vectors(spark, sf_dir), vector, text, limit)
    return M.two_passes(search, query_text(spark, sf_dir), query_vector(spark, sf_dir), 5, T.STOP_WORDS)


@query("""SELECT o_custkey AS person, o_orderkey AS doc_id, c_name AS name, 1.0::DOUBLE AS confidence, o_orderdate + INTERVAL 400 DAY AS end_date FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderdate + INTERVAL 400 DAY > TIMESTAMP '1999-01-01 00:00:00'""")
def neighbors_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.directed(edges(spark, sf_dir).filter("kind = 'person_doc'"), table(spark, sf_dir, "customer").select(F.lit("person").alias("kind"), F.col("c_custkey").cast("long").alias("id")))
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("other"), (F.col("o_orderdate") + F.expr("INTERVAL 400 DAYS")).alias("end_date"))
    now = M.current(found.join(dates, "other"), F.expr("timestamp_ntz'1999-01-01 00:00:00'"))
    named = G.with_names(now.select(F.lit("person").alias("kind"), F.col("root").alias("id"), "other", "confidence", "end_date"),
                         table(spark, sf_dir, "customer").select(F.lit("person").alias("kind"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name")))
    return named.select(F.col("id").alias("person"), F.col("other").alias("doc_id"), "name", "confidence", "end_date")


@query(f"""WITH {EDGES_SQL}, ps AS (SELECT subject, predicate, object, source, max(confidence) AS confidence FROM obs GROUP BY ALL),
ev AS (SELECT subject, predicate, object, max(confidence) AS m, product(1 - 0.4::DOUBLE * confidence) AS p FROM ps WHERE confidence > 0 GROUP BY ALL)
SELECT doc_id % 100 AS agent, 'owns_memory' AS predicate, doc_id::VARCHAR AS other, 1.0::DOUBLE AS confidence FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT subject, predicate, object, round(least(greatest(0.95::DOUBLE, m), 1 - (1 - m) * p / (1 - 0.4::DOUBLE * m)), 6) FROM ev""")
def neighbors_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = docs(spark, sf_dir).filter("sharing <> 1")
    owned = owned.select((F.col("doc_id") % 100).alias("agent"), F.lit("owns_memory").alias("predicate"), F.col("doc_id").cast("string").alias("other"), F.lit(1.0).alias("confidence"))
    told = E.compounded(E.strongest_per_source(observations(spark, sf_dir)))
    return owned.unionByName(told.select(F.col("subject").alias("agent"), "predicate", F.col("object").alias("other"), "confidence"))


@query("""WITH a AS (SELECT 0 AS branch, o_orderkey AS edge_id, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, edge_id LIMIT 15),
b AS (SELECT 1 AS branch, l_orderkey * 10 + l_linenumber AS edge_id, l_shipdate AS created_at FROM lineitem ORDER BY created_at DESC, edge_id LIMIT 15)
SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY created_at DESC, branch, edge_id LIMIT 15""")
def related_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderdate").alias("created_at"))
    b = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_shipdate").alias("created_at"))
    return M.latest_of_branches([a, b], 15)


@query("""SELECT l_partkey, event_id, n FROM (SELECT user_id AS l_partkey, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
WHERE user_id IN (SELECT l_partkey FROM lineitem)) WHERE n <= 2""")
def related_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "lineitem").select("l_partkey")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("l_partkey"), "event_id", "ts")
    found = G.latest_changes(some, log, ["l_partkey"], [F.desc("ts"), F.desc("event_id")], 2)
    return found.select("l_partkey", "event_id", F.col("n").cast("long").alias("n"))


@query("SELECT l_partkey AS entity_id, count(*) AS mentions, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mention_counts(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id")))


@query("""SELECT 'subject' AS section, NULL::TIMESTAMP AS at, c_name AS detail FROM customer WHERE c_custkey = 11
UNION ALL SELECT 'document', o_orderdate, o_orderkey::VARCHAR FROM orders WHERE o_custkey = 11
UNION ALL SELECT 'trail', ts, event_type || ' ' || event_id FROM events WHERE user_id = 11
UNION ALL SELECT 'mention', l_shipdate, l_partkey::VARCHAR FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 11""")
def why_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where what is known of one person comes from: itself, its documents, its audit trail, what they mention."""
    section = lambda df, name, at, detail: df.select(F.lit(name).alias("section"), at.alias("at"), detail.alias("detail"))
    own = table(spark, sf_dir, "orders").filter("o_custkey = 11")
    items = table(spark, sf_dir, "lineitem").join(own.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    out = section(table(spark, sf_dir, "customer").filter("c_custkey = 11"), "subject", F.lit(None).cast("timestamp_ntz"), F.col("c_name"))
    out = out.unionByName(section(own, "document", F.col("o_orderdate"), F.col("o_orderkey").cast("string")))
    trail = table(spark, sf_dir, "events").filter("user_id = 11")
    out = out.unionByName(section(trail, "trail", F.col("ts"), F.concat_ws(" ", "event_type", "event_id")))
    return out.unionByName(section(items, "mention", F.col("l_shipdate"), F.col("l_partkey").cast("string")))


@query(f"""WITH {EDGES_SQL}, l AS (SELECT *, CASE WHEN lag(object) OVER w IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh FROM obs WINDOW w AS (PARTITION BY subject, predicate ORDER BY observed_at, event_id)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, predicate ORDER BY observed_at, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS interval FROM l),
heads AS (SELECT subject, object, interval, min(observed_at) AS valid_from FROM runs GROUP BY subject, predicate, object, interval),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject ORDER BY interval) AS valid_to FROM heads)
SELECT CASE WHEN valid_to IS NULL THEN 'direct' ELSE 'superseded' END AS section, subject, interval, valid_from, valid_to FROM spans WHERE object = 'purchase'""")
def why_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and superseded edges between subjects and one object."""
    spans = E.intervals(observations(spark, sf_dir)).filter("object = 'purchase'")
    return spans.select(F.when(F.col("valid_to").isNull(), "direct").otherwise("superseded").alias("section"), "subject", "interval", "valid_from", "valid_to")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1, 2""")
def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"), "event_id", "ts")
    kept = M.keep_latest(e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], "version")
    return kept.select("user_id", "event_type", "event_id", "ts")


@query("""WITH w AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'fact' WHEN 'click' THEN 'ingest' ELSE 'save_memory' END AS kind, value > 50 AS superseding, user_id % 5 = 0 AS high_risk FROM events)
SELECT event_id, kind IN ('fact', 'ingest') AS durable, kind IN ('fact', 'ingest') AND (superseding OR high_risk) AS gate FROM w""")
def write_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "fact").when(F.col("event_type") == "click", "ingest").otherwise("save_memory")
    writes = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("value") > 50).alias("superseding"), (F.col("user_id") % 5 == 0).alias("high_risk"))
    return M.gated(writes, "silent").select("event_id", "durable", "gate")


@query("""WITH j AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 'ok' ELSE event_type END ORDER BY ts, event_id) AS o FROM events GROUP BY 1), p AS (SELECT *, coalesce(list_position(o, 'ok'), 0) AS f FROM j)
SELECT user_id, CASE WHEN f > 0 THEN least(f, 3) ELSE least(len(o), 3) END::BIGINT AS tried, CASE WHEN f BETWEEN 1 AND 3 THEN 'done' WHEN len(o) >= 3 THEN 'quarantined' ELSE 'retry' END AS next FROM p""")
def retry_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("event_type") == "purchase", "ok").otherwise(F.col("event_type"))
    # the attempts that count are three: Spark keeps no more of a user before it shuffles
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    first = table(spark, sf_dir, "events").withColumn("_r", place).filter("_r <= 3")
    listed = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", outcome.alias("o")))).alias("l"))
    return M.after_failures(listed.select("user_id", F.col("l.o").alias("outcomes"))).select("user_id", "tried", "next")


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE WHEN value > 20 THEN ts + INTERVAL 2 HOUR END AS ended FROM events WHERE event_type = 'click'), n AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT n.user_id, n.event_id AS note_id, CASE WHEN s.ended IS NULL OR s.ended > n.ts THEN s.event_id END AS session_id FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.ts <= n.ts
QUALIFY row_number() OVER (PARTITION BY n.event_id ORDER BY s.ts DESC NULLS LAST, s.event_id DESC) = 1""")
def session_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    sessions = e.filter("event_type = 'click'").select(F.col("user_id").alias("actor"), F.col("ts").alias("started_at"), F.when(F.col("value") > 20, F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("ended_at"), F.col("event_id").alias("session_id"))
    notes = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("actor"), F.col("ts").alias("at"), F.col("event_id").alias("note_id"))
    return M.noted(notes, sessions).select(F.col("actor").alias("user_id"), "note_id", "session_id")


@query("""WITH d AS (SELECT p_partkey AS doc_id, p_brand AS source, string_split(p_type, ' ')[1] AS m, p_name AS name FROM part), r(id, p, m, n) AS (VALUES (1, 10, 'ECONOMY', NULL), (2, 20, NULL, 'green')),
b AS (SELECT d.doc_id, arg_min(r.id, r.p) AS rule_id FROM d JOIN r ON (r.m IS NULL OR r.m = d.m) AND (r.n IS NULL OR contains(lower(d.name), r.n)) GROUP BY 1)
SELECT d.doc_id, CASE WHEN source IN ('Brand#2', 'Brand#5') THEN 1 ELSE 2 END AS sharing, rule_id FROM d LEFT JOIN b USING (doc_id) WHERE source NOT IN ('Brand#1', 'Brand#3')""")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("source"), F.split("p_type", " ")[0].alias("mime_type"), F.col("p_name").alias("name"))
    profiles = d.select("source", (~F.col("source").isin("Brand#1", "Brand#3")).alias("active"), F.col("source").isin("Brand#2", "Brand#5").alias("private")).distinct()
    rules = spark.createDataFrame([(1, 10, "ECONOMY", None), (2, 20, None, "GREEN")], "rule_id int, priority int, mime_type string, name_contains string")
    return M.profiled(d, profiles, rules).select("doc_id", "sharing", "rule_id")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR list_contains([p_brand, p_type], 'Brand#13')""")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("aliases"))
    found = M.named_like(names, "Ring").unionByName(M.named_like(names, "Brand#13")).dropDuplicates(["p_partkey"])
    return found.select("p_partkey", F.col("name").alias("p_name"))


@query("""WITH m AS (SELECT DISTINCT o_orderkey::VARCHAR AS id FROM orders WHERE starts_with(o_orderkey::VARCHAR, '123'))
SELECT CASE WHEN count(*) = 1 THEN min(id) END AS id, CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS state FROM m""")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.by_id_prefix(table(spark, sf_dir, "orders"), "o_orderkey", "123")


@query("SELECT event_id, strftime(ts, '%b ') || day(ts) AS saved, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def saved_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "MMM d").alias("saved"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


NAME_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'agency', 'client', 'account', 'inc', 'llc', 'co', 'company', 'corp')))"


@query(f"""SELECT a.p_partkey, list_has_any({NAME_WORDS.format("a.p_name")}, {NAME_WORDS.format("b.p_name")}) AS same FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def same_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    b = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return a.join(b, "p_partkey").select("p_partkey", T.same_entity(F.col("a"), F.col("b")).alias("same"))


FUNCTIONAL_SQL = "f AS (SELECT event_id, user_id AS subject, CASE WHEN event_type IN ('click', 'purchase') THEN 'Currently located_in' ELSE 'knows' END AS predicate, (user_id * 7 + event_id) % 4 AS object, ts FROM events)"


@query(f"""WITH {FUNCTIONAL_SQL}, one AS (SELECT subject, object, ts, event_id FROM f WHERE predicate <> 'knows')
SELECT subject, 'functional' AS kind, arg_max(object, (ts, event_id)) AS object FROM one GROUP BY subject UNION ALL SELECT DISTINCT subject, 'plain', object FROM f WHERE predicate = 'knows'""")
def functional_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds at the end: one object of a functional predicate, every object of the others."""
    predicate = F.when(F.col("event_type").isin("click", "purchase"), "Currently located_in").otherwise("knows")
    seen = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("subject"), predicate.alias("predicate"), ((F.col("user_id") * 7 + F.col("event_id")) % 4).alias("object"),
                                                 F.lit("s").alias("source"), F.lit(0.5).alias("confidence"), F.col("ts").alias("observed_at"))
    one, rest = M.functional_only(seen)
    current = E.intervals(one).filter("valid_to IS NULL").select("subject", F.lit("functional").alias("kind"), "object")
    return current.unionByName(rest.select("subject", F.lit("plain").alias("kind"), "object").distinct())


@query("""SELECT user_id AS workspace, least(count(*), 101) AS n FROM events GROUP BY 1""")
def bounded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace"), "event_id")
    return A.bounded(rows, ["workspace"], "event_id", 101)


@query("""SELECT event_type, round(avg(value), 6) AS mean, max(value) AS highest, arg_max(value, (ts, event_id)) AS latest, count(*) AS n FROM events GROUP BY 1""")
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("highest"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), F.count("*").alias("n")
    )


@query("""SELECT coalesce(o_orderpriority, 'all') AS category, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END), 6) AS adherence FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def routing_adherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)), 6)
    by = table(spark, sf_dir, "orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), right.alias("adherence"))
    return by.select(F.coalesce("o_orderpriority", F.lit("all")).alias("category"), "n", "adherence")


@query("""WITH a AS (SELECT p_brand AS canonical, unnest([p_brand, p_type, string_split(p_name, ' ')[1]]) AS alias FROM part)
SELECT canonical, list_sort(list_distinct(list(alias))) AS aliases FROM a WHERE alias <> canonical GROUP BY 1""")
def alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("canonical"), F.array("p_brand", "p_type", F.split("p_name", " ")[0]).alias("a"))
    listed = names.select("canonical", F.explode("a").alias("alias")).distinct().groupBy("canonical").agg(F.collect_set("alias").alias("a"))
    return listed.select("canonical", F.array_sort(F.array_except("a", F.array("canonical"))).alias("aliases"))


@query("""SELECT doc_id FROM documents WHERE source LIKE 'src1%' UNION SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' AND l_orderkey IN (SELECT doc_id FROM documents)""")
def purge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    old = table(spark, sf_dir, "lineitem").filter("l_shipdate < timestamp_ntz'1995-06-01 00:00:00'").select(F.col("l_orderkey").alias("doc_id"))
    return d.filter("source LIKE 'src1%'").select("doc_id").union(old.join(d, "doc_id", "left_semi")).distinct()


@query("""WITH s AS (SELECT event_type AS name, count(DISTINCT CAST(ts AS DATE)) AS seen_count FROM events GROUP BY 1), r AS (SELECT event_type AS name, CASE WHEN min(value) < 0.05 THEN 'approved' ELSE 'pending' END AS state FROM events GROUP BY 1)
SELECT s.name, seen_count FROM s JOIN r USING (name) WHERE state = 'pending'""")
def proposals_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"))
    seen = by.agg(F.count_distinct(F.to_date("ts")).alias("seen_count"))
    return M.unreviewed(seen, by.agg(F.when(F.min("value") < 0.05, "approved").otherwise("pending").alias("state")))


@query("""WITH d AS (SELECT doc_id FROM documents WHERE NOT source LIKE 'src1%'), o AS (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents WHERE source LIKE 'src1%'))
SELECT 'documents' AS name, count(*) AS kept FROM d UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE source LIKE 'src1%')""")
def purge_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of some sources go, with the orders and vectors that refer to them and the lines of these orders."""
    tables = {n: table(spark, sf_dir, n) for n in ("documents", "orders", "lineitem", "embeddings")}
    gone = {"documents": tables["documents"].filter("source LIKE 'src1%'").select("doc_id")}
    references = {"orders": {"o_orderkey": "documents"}, "lineitem": {"l_orderkey": "orders"}, "embeddings": {"vec_id": "documents"}}
    left = M.purged(tables, gone, references, {"documents": "doc_id", "orders": "o_orderkey"})
    counts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("kept")) for name, rows in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS position, p_brand AS subject, p_type AS object FROM lineitem JOIN part ON p_partkey = l_partkey),
own AS (SELECT doc_id, lower(subject) AS name, object AS alias FROM r WHERE position = 1),
ends AS (SELECT doc_id, position * 2 AS pos, subject AS name FROM r UNION ALL SELECT doc_id, position * 2 + 1, object FROM r),
lacking AS (SELECT doc_id, lower(name) AS key, min(pos) AS pos FROM ends e WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = e.doc_id AND lower(e.name) IN (o.name, lower(o.alias))) GROUP BY 1, 2),
asked AS (SELECT doc_id, key FROM lacking QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos, key) <= 8)
SELECT DISTINCT doc_id, name, false AS recovered FROM own UNION ALL SELECT doc_id, p_brand, true FROM asked JOIN (SELECT DISTINCT p_brand FROM part) ON lower(p_brand) = key""")
def endpoint_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines relate a brand to a type; only the first line's are known as entities, and a
    second look that knows brands alone is asked for the rest."""
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").join(brands, "l_partkey")
    relations = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), F.col("p_brand").alias("subject"), F.col("p_type").alias("object"))
    first = relations.filter("position = 1").groupBy("doc_id", F.lower("subject").alias("name"))
    own = first.agg(F.collect_set("object").alias("aliases"), F.lit(0.9).alias("confidence"))
    asked = X.missing_endpoints(own, relations)
    found = relations.select("doc_id", F.col("subject").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(0.5).alias("confidence"))
    return X.with_recovered(own, found, asked).select("doc_id", "name", "recovered")
