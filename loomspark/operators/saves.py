"""Saving memories: each save is an event with its document, chunk, evidence, session and note, or nothing at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import preview, sanitize
from loomspark.operators.analytics import milestone
from loomspark.operators.commits import BatchStore
from loomspark.operators.curation import valid_envelopes

#: Type and subtype of a memory's document, its sharing, the kind of its note, the edge it proves.
MEMORY_TYPE, MEMORY_SUBTYPE, SHARED_IN_WORKSPACE, NOTE_KIND, SAVED = 80, 200, 2, "fact", "saved_memory"
#: Reading another agent's memory, and writing under a trace that another agent began.
RECALLED, SHARES_TRACE = "recalled_memory", "shares_trace"
_WHO = "workspace string, agent string"
SCHEMAS = {
    "events": f"event_id string, {_WHO}, idempotency_key string, trace_id string, span_id string, causal_parent_id string, payload string, summary string, status string, at timestamp_ntz",
    "documents": f"document_id string, {_WHO}, type_id int, subtype_id int, sharing int, name string, state string, created_at timestamp_ntz",
    "chunks": "chunk_id string, document_id string, workspace string, chunk_index int, text string, metadata map<string,string>",
    "evidence": "evidence_id string, workspace string, kind string, source string, target string, predicate string, document_id string, chunk_id string, confidence double, row_id string",
    "sessions": f"session_id string, {_WHO}, started_at timestamp_ntz",
    "notes": f"note_id string, session_id string, {_WHO}, kind string, content string, idempotency_key string, trace_id string, span_id string, at timestamp_ntz",
    "milestones": "workspace string, event_id string, count long, message string",
    "rejected": f"{_WHO}, idempotency_key string, problem string",
}


def key_of(kind: str, *parts: str) -> Column:
    """An id that depends on its parts only, so a save that is tried again has the same ids."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, ... 11th, ... 1,000th."""
    teen = (n % 100).between(11, 13)
    ending = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(F.format_number(n, 0), ending)


def milestones(saved: DataFrame, before: DataFrame) -> DataFrame:
    """(workspace, event_id, count, message) of the saves (workspace, event_id, at) that reach a milestone;
    ``before`` has workspace and n, what was there earlier.

    Days are counted first, and only the days in which a milestone falls are numbered row by row, so a
    workspace with most of the rows is not one sort.
    """
    day = F.date_trunc("day", "at")
    days = saved.groupBy("workspace", day.alias("_day")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("workspace").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.join(before.select("workspace", "n"), "workspace", "left")
    days = days.withColumn("_before", F.coalesce("n", F.lit(0)) + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    upto = F.col("_before") + F.col("_n")
    crossed = F.lit(False)
    for least in (10, 50, 100):
        crossed = crossed | ((F.col("_before") < least) & (upto >= least))
    crossed = crossed | (F.floor(upto / 250) > F.floor(F.col("_before") / 250))
    rows = saved.withColumn("_day", day).join(days.filter(crossed).select("workspace", "_day", "_before"), ["workspace", "_day"])
    place = F.row_number().over(Window.partitionBy("workspace", "_day").orderBy("at", "event_id"))
    rows = rows.withColumn("count", milestone(F.col("_before") + place)).filter("count IS NOT NULL")
    message = F.concat(F.lit("Stored the "), ordinal(F.col("count")), F.lit(" memory in this workspace."))
    return rows.select("workspace", "event_id", F.col("count").cast("long").alias("count"), message.alias("message"))


def save_memories(store: BatchStore, batch: str, requests: DataFrame, **options) -> bool:
    """Commit the saves in ``requests`` as one batch; False if the batch is committed already.

    Requests: workspace, agent, idempotency_key, trace_id, span_id, causal_parent_id, content, payload,
    source_label, at. Of a key of a workspace the first request in time counts, if no earlier batch has the
    key; others are replays and leave nothing. Requests whose envelope is invalid are rejected with their
    problem. A note goes to the open session of its agent, which is made if there is none.
    """
    if batch in store.committed():
        return False
    requests = valid_envelopes(requests.withColumn("kind", F.lit("save_memory")))
    rejected = requests.filter("problem IS NOT NULL").select("workspace", "agent", "idempotency_key", "problem")
    known = store.read("events", SCHEMAS["events"]).select("workspace", "idempotency_key").distinct()
    key = ["workspace", "idempotency_key"]
    whole = [c for c in requests.columns if c not in (*key, "problem", "kind")]
    # the first of a key, by a minimum that map-side combines; ties by the rest of the row
    first = requests.filter("problem IS NULL").groupBy(*key).agg(F.min(F.struct("at", *(c for c in whole if c != "at"))).alias("r")).select(*key, "r.*")
    new = first.join(known, key, "left_anti").withColumn("content", sanitize(F.coalesce("content", F.lit(""))))
    new = new.withColumns({"event_id": key_of("event", *key), "span_id": F.coalesce("span_id", F.left(key_of("span", *key), F.lit(16)))})
    new = new.withColumns({"document_id": key_of("document", "event_id"), "chunk_id": key_of("chunk", "event_id")}).cache()
    old = store.read("sessions", SCHEMAS["sessions"])
    latest = old.groupBy("workspace", "agent").agg(F.max_by("session_id", F.struct("started_at", "session_id")).alias("session_id"))
    lacking = new.groupBy("workspace", "agent").agg(F.min("at").alias("started_at")).join(latest, ["workspace", "agent"], "left_anti")
    opened = lacking.withColumn("_when", F.date_format("started_at", "yyyyMMddHHmmssSSSSSS"))
    opened = opened.select(key_of("session", "workspace", "agent", "_when").alias("session_id"), "workspace", "agent", "started_at")
    of_agent = latest.unionByName(opened.select("workspace", "agent", "session_id"))
    metadata = F.map_filter(
        F.create_map(*(x for c in ("source_label", "trace_id", "span_id", "causal_parent_id") for x in (F.lit(c), F.col(c)))), lambda _, v: v.isNotNull()
    )
    stored = store.read("documents", SCHEMAS["documents"]).filter(F.col("type_id") == MEMORY_TYPE).groupBy("workspace").agg(F.count("*").alias("n"))
    tables = {
        "events": new.select("event_id", "workspace", "agent", "idempotency_key", "trace_id", "span_id", "causal_parent_id", "payload", F.col("content").alias("summary"), F.lit("completed").alias("status"), "at"),
        "documents": new.select(
            "document_id", "workspace", "agent", F.lit(MEMORY_TYPE).alias("type_id"), F.lit(MEMORY_SUBTYPE).alias("subtype_id"), F.lit(SHARED_IN_WORKSPACE).alias("sharing"),
            preview(F.col("content")).alias("name"), F.lit("done").alias("state"), F.col("at").alias("created_at"),
        ),
        "chunks": new.select("chunk_id", "document_id", "workspace", F.lit(0).alias("chunk_index"), F.col("content").alias("text"), metadata.alias("metadata")),
        "evidence": agent_memory(new).unionByName(shared_traces(store, new)),
        "sessions": opened,
        "notes": new.join(of_agent, ["workspace", "agent"]).select(
            key_of("note", "event_id").alias("note_id"), "session_id", "workspace", "agent", F.lit(NOTE_KIND).alias("kind"), "content", "idempotency_key", "trace_id", "span_id", "at"
        ),
        "milestones": milestones(new, stored),
        "rejected": rejected,
    }
    try:
        return store.commit(batch, tables, **options)
    finally:
        new.unpersist()


def agent_memory(saves: DataFrame) -> DataFrame:
    """The evidence that an agent saved a memory: an edge from the agent to its document."""
    return saves.select(
        key_of("agent_memory", "event_id").alias("evidence_id"), "workspace", F.lit("agent_memory").alias("kind"), F.col("agent").alias("source"),
        F.col("document_id").alias("target"), F.lit(SAVED).alias("predicate"), "document_id", "chunk_id", F.lit(1.0).alias("confidence"), F.col("event_id").alias("row_id"),
    )


def shared_traces(store: BatchStore, saves: DataFrame) -> DataFrame:
    """Edges between agents: from whoever writes under a trace to the agent that began it, once a trace and pair."""
    trace = ["workspace", "trace_id"]
    earlier = store.read("events", SCHEMAS["events"]).select(*trace, "agent", "at", "event_id")
    every = earlier.unionByName(saves.select(*trace, "agent", "at", "event_id"))
    began = every.groupBy(*trace).agg(F.min_by("agent", F.struct("at", "event_id")).alias("target"))
    proven = earlier.select(*trace, "agent").distinct()
    pairs = saves.select(*trace, "agent").distinct().join(proven, [*trace, "agent"], "left_anti").join(began, trace).filter("agent <> target")
    none = F.lit(None).cast("string")
    return pairs.select(
        key_of("agent_agent", "workspace", "trace_id", "agent", "target").alias("evidence_id"), "workspace", F.lit("agent_agent").alias("kind"), F.col("agent").alias("source"), "target",
        F.lit(SHARES_TRACE).alias("predicate"), none.alias("document_id"), none.alias("chunk_id"), F.lit(1.0).alias("confidence"), F.col("trace_id").alias("row_id"),
    )


def recalls(log: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges between agents from what they read: (workspace, agent, document_id) of a log against the owners of
    the documents; one edge a pair of agents and workspace, with the number of recalls as ``n``."""
    owned = documents.select("workspace", "document_id", F.col("agent").alias("target"))
    pairs = log.join(owned, ["workspace", "document_id"]).filter("agent <> target").groupBy("workspace", "agent", "target").agg(F.count("*").alias("n"))
    return pairs.select(
        key_of("agent_recall", "workspace", "agent", "target").alias("evidence_id"), "workspace", F.lit("agent_agent").alias("kind"), F.col("agent").alias("source"), "target",
        F.lit(RECALLED).alias("predicate"), F.lit(1.0).alias("confidence"), "n",
    )
