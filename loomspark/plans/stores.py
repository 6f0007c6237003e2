"""Queries over stored state: saves in batches, merged tables, logs, forests, live edges, sessions, JSON, benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import variants as V
from loomspark.operators import commits, forest, query_log, saves
from loomspark.operators.lineage import new_folder
from loomspark.plans.evidence import NOISY, OR_SQL
from loomspark.plans.views import observations
from loomspark.registry import query, table
from loomspark.sources import benchmarks
from loomspark.streaming import edges as live

REQUESTS_SQL = """req AS (SELECT event_id AS row_no, event_type AS workspace, 'u' || user_id AS agent, user_id || '-' || strftime(ts, '%Y-%m-%d') AS idempotency_key,
  CASE WHEN event_id % 89 = 0 THEN ' ' ELSE 't' || strftime(ts, '%Y%m%d%H') END AS trace_id, event_type || ' ' || props AS content, ts AS made FROM events),
good AS (SELECT * FROM req WHERE trim(trace_id) <> ''),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workspace, idempotency_key ORDER BY made, row_no) AS r FROM good) WHERE r = 1),
ids AS (SELECT *, sha256('event|' || workspace || '|' || idempotency_key) AS event_id FROM ev),
ses AS (SELECT workspace, agent, sha256('session|' || workspace || '|' || agent || '|' || strftime(min(made), '%Y%m%d%H%M%S%f')) AS session_id FROM ids GROUP BY workspace, agent)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to save: one key a user, type and day, so many are replays; every 89th has no trace."""
    e, none = table(spark, sf_dir, "events"), F.lit(None).cast("string")
    day, hour = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyyMMddHH")
    return e.select(
        F.col("event_type").alias("workspace"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent"), F.concat_ws("-", F.col("user_id").cast("string"), day).alias("idempotency_key"),
        F.when(F.col("event_id") % 89 == 0, " ").otherwise(F.concat(F.lit("t"), hour)).alias("trace_id"), none.alias("span_id"), none.alias("causal_parent_id"),
        F.concat_ws(" ", "event_type", "props").alias("content"), F.col("props").alias("payload"), F.lit("events").alias("source_label"), F.col("ts").cast("timestamp_ntz").alias("at"),
    )


def _saved(spark: SparkSession, sf_dir: str) -> commits.BatchStore:
    """All requests saved in two batches by time; then both come again, one under its name and one under another."""
    store, requests = commits.BatchStore(spark, new_folder(spark, "memories")), _requests(spark, sf_dir)
    middle = requests.select(F.timestamp_micros(F.avg(F.unix_micros(F.col("at").cast("timestamp"))).cast("long")).cast("timestamp_ntz").alias("m")).first()
    soon = F.coalesce(F.col("at") <= F.lit(middle.m), F.lit(False))
    early = requests.filter(soon)
    for name, rows in (("one", early), ("two", requests.filter(~soon)), ("one", early), ("three", requests)):
        saves.save_memories(store, name, rows)
    return store


@query(f"""WITH {REQUESTS_SQL} SELECT workspace, agent, idempotency_key, event_id, CASE WHEN length(content) > 120 THEN left(content, 117) || '...' ELSE content END AS name, content AS text,
  'saved_memory' AS predicate, sha256('document|' || event_id) AS document_id, session_id FROM ids JOIN ses USING (workspace, agent)""")
def save_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, s = _saved(spark, sf_dir), saves.SCHEMAS
    events = store.read("events", s["events"]).select("workspace", "agent", "idempotency_key", "event_id")
    proof = store.read("evidence", s["evidence"]).filter("kind = 'agent_memory'").select(F.col("row_id").alias("event_id"), "predicate", "document_id", "chunk_id")
    out = events.join(proof, "event_id").join(store.read("documents", s["documents"]).select("document_id", "name"), "document_id")
    out = out.join(store.read("chunks", s["chunks"]).select("chunk_id", "text"), "chunk_id").drop("chunk_id")
    return out.join(store.read("notes", s["notes"]).select("workspace", "idempotency_key", "session_id"), ["workspace", "idempotency_key"])


@query(f"""WITH {REQUESTS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY made, event_id) AS n FROM ids)
SELECT workspace, event_id, n AS count, 'Stored the ' || format('{{:,}}', n) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END
  || ' memory in this workspace.' AS message FROM n WHERE n IN (10, 50, 100) OR n % 250 = 0""")
def save_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _saved(spark, sf_dir).read("milestones", saves.SCHEMAS["milestones"]).drop("batch")


@query(f"""WITH {REQUESTS_SQL}, b AS (SELECT workspace, trace_id, arg_min(agent, (made, event_id)) AS target FROM ids GROUP BY ALL)
SELECT DISTINCT workspace, agent AS source, target, trace_id, 'shares_trace' AS predicate FROM ids JOIN b USING (workspace, trace_id) WHERE agent <> target""")
def save_shared_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    proof = _saved(spark, sf_dir).read("evidence", saves.SCHEMAS["evidence"]).filter("kind = 'agent_agent'")
    return proof.select("workspace", "source", "target", F.col("row_id").alias("trace_id"), "predicate")


@query(f"WITH {REQUESTS_SQL} SELECT workspace, agent, idempotency_key, 'trace_id' AS problem, count(*) AS requests FROM req WHERE trim(trace_id) = '' GROUP BY ALL")
def save_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = commits.BatchStore(spark, new_folder(spark, "memories"))
    saves.save_memories(store, "all", _requests(spark, sf_dir))
    return store.read("rejected", saves.SCHEMAS["rejected"]).groupBy("workspace", "agent", "idempotency_key", "problem").agg(F.count("*").alias("requests"))


@query("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 <> 3),
new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 4 IN (0, 3))
SELECT n.o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS op, o.o_orderstatus AS old_status, n.o_orderstatus AS new_status
FROM new n LEFT JOIN old o USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM n.o_orderstatus""")
def upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, rows = new_folder(spark, "orders"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(1).alias("version"))
    commits.upsert(spark, path, rows.filter("o_orderkey % 4 <> 3"), ["o_orderkey"], "version")
    status = F.when(F.col("o_orderkey") % 8 == 0, "X").otherwise(F.col("o_orderstatus"))
    later = rows.filter("o_orderkey % 4 IN (0, 3)").withColumns({"o_orderstatus": status, "version": F.when(status == F.col("o_orderstatus"), 1).otherwise(2)})
    made = commits.upsert(spark, path, later, ["o_orderkey"], "version")
    return made.select("o_orderkey", "op", F.col("old.o_orderstatus").alias("old_status"), F.col("new.o_orderstatus").alias("new_status"))


@query("""WITH RECURSIVE n AS (SELECT event_type AS trace, event_id, CASE WHEN event_id % 500 < 3 THEN NULL WHEN event_id % 997 = 5 THEN -event_id ELSE event_id - 3 * (1 + event_id % 2) END AS parent FROM events),
t AS (SELECT n.*, EXISTS (SELECT 1 FROM n p WHERE p.trace = n.trace AND p.event_id = n.parent) AS has FROM n),
w AS (SELECT trace, event_id, event_id AS root, 0 AS depth FROM t WHERE NOT has UNION ALL SELECT t.trace, t.event_id, w.root, w.depth + 1 FROM w JOIN t ON t.has AND t.trace = w.trace AND t.parent = w.event_id)
SELECT w.trace, w.event_id, w.root, w.depth::BIGINT AS depth, n.parent IS NOT NULL AND NOT t.has AS orphan, false AS cyclic FROM w JOIN t USING (trace, event_id) JOIN n USING (trace, event_id)""")
def causal_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    id = F.col("event_id")
    parent = F.when(id % 500 < 3, None).when(id % 997 == 5, -id).otherwise(id - 3 * (1 + id % 2))
    nodes = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace"), "event_id", parent.alias("parent"))
    return forest.ranked(nodes, "trace", "event_id", "parent")


def _in_batches(spark: SparkSession, rows: DataFrame, name: str, batches: int, order: Column, files: int = 8) -> DataFrame:
    """``rows`` as a stream of ``batches`` micro-batches, written first: a file has one remainder of ``order``, a batch ``files`` files."""
    path, part = new_folder(spark, name), F.pmod(order, F.lit(batches * files)).cast("int")
    rows.withColumn("_part", part).repartitionById(batches * files, "_part").write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


@query(f"WITH {OR_SQL} SELECT subject, predicate, object, sha256(concat_ws('|', subject, predicate, object)) AS edge_id, sources, round({NOISY}, 6) AS confidence FROM agg")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observations(spark, sf_dir).select("event_id", "subject", "predicate", "object", "source", "confidence")
    # shuffled, late and with a third of the rows twice
    twice = seen.unionByName(seen.filter("event_id % 3 = 0"))
    stream = _in_batches(spark, twice, "sightings", 4, F.xxhash64("event_id"))
    scratch = new_folder(spark, "live")
    live.run_live_edges(stream, f"{scratch}/offsets", f"{scratch}/edges")
    return live.edges_now(spark.read.parquet(f"{scratch}/edges")).filter("sources > 0").drop("made_in")


@query("""WITH n AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events),
g AS (SELECT *, sum(CASE WHEN since IS NULL OR since >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM n),
s AS (SELECT user_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS notes FROM g GROUP BY user_id, g)
SELECT user_id, sha256(user_id || '|' || epoch_us(started_at)) AS session_id, started_at, ended_at, notes FROM s WHERE ended_at + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = new_folder(spark, "sessions")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    path = new_folder(spark, "notes")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    made = live.sessions(stream, "user_id", "at", "12 hours", "1 hour")
    made.writeStream.outputMode("append").option("checkpointLocation", f"{scratch}/offsets").option("path", f"{scratch}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{scratch}/rows")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})


@query("""SELECT 'neighbors' AS tool, '[REDACTED]' AS api_key, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS rows, 1 AS calls, 0 AS failures
UNION ALL SELECT 'milestones', NULL, (SELECT count(DISTINCT event_type) FROM events), 2, 1""")
def query_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = query_log.QueryLog(spark, new_folder(spark, "log"))
    with log.call("neighbors", api_key="secret", tables=["lineitem"]) as call:
        call.observe(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()).write.format("noop").mode("overwrite").save()
    with log.call("milestones", table="events") as call:
        call.observe(table(spark, sf_dir, "events").groupBy("event_type").count()).write.format("noop").mode("overwrite").save()
    try:
        with log.call("milestones", table="none"):
            raise LookupError("no such table")
    except LookupError:
        pass
    rows = log.read()
    asked = rows.groupBy("tool").agg(F.max(F.element_at("input", "api_key")).alias("api_key"))
    return query_log.running_metrics(rows).join(asked, "tool").select("tool", "api_key", "rows", F.col("calls").cast("int"), F.col("failures").cast("int"))


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", V.parsed(F.col("props")).alias("v"))
    return V.listed(parsed, "v", "event_id").select("event_id", "key", V.read(F.col("value"), "$").alias("value"))


@query("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'kept' END AS kind, user_id AS seen_by, true AS seen_here,
  CASE WHEN event_id % 2 = 0 THEN 4 ELSE 3 END AS n_fields FROM events""")
def variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    own = V.with_field(V.parsed(F.col("props")), ["kind"], V.parsed(F.lit('"kept"')))
    extra = F.when(F.col("event_id") % 2 == 0, V.parsed(F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit(1).alias("even"))))).otherwise(V.parsed(F.lit("{}")))
    v = V.with_field(V.merged(own, extra), ["seen", "by"], F.col("user_id").cast("variant"))
    v = V.with_field(v, ["seen", "here"], F.lit(True).cast("variant"))
    e = e.select("event_id", v.alias("v"))
    return e.select(
        "event_id", V.read(F.col("v"), "$.k", "bigint").alias("k"), V.read(F.col("v"), "$.kind").alias("kind"), V.read(F.col("v"), "$.seen.by", "bigint").alias("seen_by"),
        V.read(F.col("v"), "$.seen.here", "boolean").alias("seen_here"), F.size(V.fields(F.col("v"))).alias("n_fields"),
    )


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, text FROM conversations),
d AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS question_id, n.n AS turns, 'q' || conv_id AS question, CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE 'kind' || conv_id % 3 END AS category,
  CASE WHEN conv_id % 2 = 0 THEN TIMESTAMP '2023-04-10 17:50:00' ELSE TIMESTAMP '2023-04-11 00:00:00' END AS date, '[User]: ' || coalesce((SELECT text FROM t WHERE t.conv_id = d.conv_id AND r = 1), '') AS first_line
FROM d JOIN (SELECT conv_id AS c, n FROM d) n ON n.c = conv_id""")
def benchmark_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as questions in two of the shapes that files have, then read back."""
    c = table(spark, sf_dir, "conversations")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.struct(F.lit("human").alias("role"), t["text"].alias("content")))
    rows = c.groupBy("conv_id").agg(turns.alias("t"))
    id, kind = F.col("conv_id").cast("string"), F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("kind"), (F.col("conv_id") % 3).cast("string")))
    one = F.to_json(F.struct(id.alias("id"), F.concat(F.lit("q"), id).alias("question"), kind.alias("category"), F.array("t").alias("sessions"), F.array(F.lit("2023/04/10 (Mon) 17:50")).alias("haystack_dates")))
    two = F.to_json(F.struct(id.alias("question_id"), F.concat(F.lit("q"), id).alias("question"), kind.alias("question_type"), F.col("t").alias("context"), F.array(F.lit("2023/04/11 (Tue)")).alias("haystack_dates")))
    found = benchmarks.examples(rows.select(F.when(F.col("conv_id") % 2 == 0, one).otherwise(two).alias("value")))
    texts = benchmarks.session_texts(found).select("question_id", F.col("date").cast("timestamp_ntz").alias("date"), F.split("text", "\n\\[User\\]: ")[0].alias("first_line"))
    return found.select("question_id", F.size(F.col("sessions")[0]).cast("long").alias("turns"), "question", "category").join(texts, "question_id")
