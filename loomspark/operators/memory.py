"""Memory tools over the tables: sinks that keep the latest row, write gating and retries, session notes,
source profiles, provenance, recall and the context pack."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.text import predicate_name
from loomspark.operators import ranking as R
from loomspark.operators.curation import first_rule

#: Predicates of which a subject has one current object.
FUNCTIONAL_PREDICATES = ("works for", "reports to", "located in")
#: Kinds of writes that change what is known for good.
DURABLE_KINDS = ("fact", "ingest")


def keep_latest(stored: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """An upsert as a new table: of each key the row of the highest version; of equals the batch's.

    One aggregate with a map-side combine, no window: a key with very many versions is no single task.
    """
    rows = stored.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(F.col(version), F.col("_new")))
    return rows.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*").select(*stored.columns)


def gated(writes: DataFrame, mode: str) -> DataFrame:
    """Add durable and gate to ``writes`` (kind, superseding, high_risk): what waits for approval.

    Only durable writes ever wait: all of them in the mode "audit", else those that supersede a fact or
    are of high risk. Null flags count as false.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    durable = F.coalesce(F.col("kind").isin(*DURABLE_KINDS), F.lit(False))
    return writes.withColumn("durable", durable).withColumn("gate", durable & (F.lit(mode == "audit") | flag("superseding") | flag("high_risk")))


def after_failures(jobs: DataFrame, attempts: int = 3) -> DataFrame:
    """Add ``next`` to jobs (outcomes: array of "ok" or an error, in order): done at the first ok, retry
    while attempts are left, quarantined afterwards; and ``tried``, the attempts that count."""
    first = F.array_position("outcomes", "ok")
    tried = F.when(first > 0, F.least(first, F.lit(attempts))).otherwise(F.least(F.size("outcomes"), F.lit(attempts)))
    state = F.when((first > 0) & (first <= attempts), "done").when(F.size("outcomes") >= attempts, "quarantined").otherwise("retry")
    return jobs.withColumns({"tried": tried.cast("long"), "next": state})


def noted(notes: DataFrame, sessions: DataFrame, actor: str = "actor") -> DataFrame:
    """Each note (actor, at, note_id) with the latest session (actor, started_at, ended_at, session_id) of
    its actor that was open then; null where a new one has to be made.

    An as-of join without a join: sessions and notes stand in one order per actor.
    """
    opened = sessions.select(actor, F.col("started_at").alias("at"), F.lit(0).alias("_k"), F.lit(None).cast("long").alias("note_id"),
                             F.struct("started_at", "session_id", "ended_at").alias("_s"))
    written = notes.select(actor, "at", F.lit(1).alias("_k"), "note_id", F.lit(None).cast(opened.schema["_s"].dataType).alias("_s"))
    order = Window.partitionBy(actor).orderBy("at", "_k", "_s", "note_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = opened.unionByName(written).withColumn("_s", F.last("_s", ignorenulls=True).over(order)).filter("_k = 1")
    still = F.col("_s.ended_at").isNull() | (F.col("_s.ended_at") > F.col("at"))
    return rows.select(actor, "note_id", "at", F.when(still, F.col("_s.session_id")).alias("session_id"))


def profiled(docs: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, mime_type, name) with the sharing and rule they are ingested with.

    Profiles (source, active, private) decide: an inactive or unknown source gives no row; a private one
    shares with its agent only (1), others with the workspace (2).
    """
    own = docs.join(profiles.filter("active").select("source", "private"), "source")
    own = own.withColumn("sharing", F.when(F.col("private"), 1).otherwise(2)).drop("private")
    return own.join(first_rule(docs, rules), "doc_id", "left")


def named_like(names: DataFrame, part: str) -> DataFrame:
    """Rows (name, aliases) whose name has ``part`` in any case, or that have it as a whole alias."""
    part_of = F.lower("name").contains(part.lower())
    return names.filter(F.coalesce(part_of, F.lit(False)) | F.coalesce(F.array_contains("aliases", part), F.lit(False)))


def by_id_prefix(rows: DataFrame, id: str, prefix: str) -> DataFrame:
    """One row: the only id that begins with ``prefix``, or null, and whether it is found, unknown or ambiguous."""
    some = rows.filter(F.col(id).cast("string").startswith(prefix)).select(F.col(id).cast("string").alias("_id")).distinct().limit(2)
    state = F.when(F.count("*") == 0, "unknown").when(F.count("*") == 1, "found").otherwise("ambiguous")
    return some.agg(F.when(F.count("*") == 1, F.min("_id")).alias("id"), state.alias("state"))


def unreviewed(proposals: DataFrame, reviewed: DataFrame, key: str = "name") -> DataFrame:
    """Sightings change pending proposals only: what a reviewed row (key, state) has decided stays as it is."""
    return proposals.join(reviewed.filter("state <> 'pending'").select(key), key, "left_anti")


def functional_only(seen: DataFrame, more: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(sightings of functional predicates, all others): only the first supersede each other."""
    known = [*FUNCTIONAL_PREDICATES, *more]
    is_one = F.coalesce(F.regexp_replace(predicate_name(F.col("predicate")), "[_-]+", " ").isin(known), F.lit(False))
    return seen.filter(is_one), seen.filter(~is_one)


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(entity_id, mentions, documents): how often and in how many documents each entity is mentioned."""
    return mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("documents"))


def current(edges: DataFrame, as_of: Column, end: str = "end_date") -> DataFrame:
    """Edges without an end or with one after ``as_of``."""
    return edges.filter(F.col(end).isNull() | (F.col(end) > as_of))


def latest_of_branches(branches: list[DataFrame], limit: int, created: str = "created_at", id: str = "edge_id") -> DataFrame:
    """The ``limit`` latest rows of each branch, merged by time, and of these the ``limit`` latest: top-ks."""
    order = [F.desc_nulls_last(created), F.asc("branch"), F.asc(id)]
    out = None
    for k, rows in enumerate(branches):
        some = rows.withColumn("branch", F.lit(k)).orderBy(*order).limit(limit)
        out = some if out is None else out.unionByName(some)
    return out.orderBy(*order).limit(limit)


def recall(docs: DataFrame, vectors: DataFrame, query_vector: list[float], query: str, k: int, agent: str | None = None) -> DataFrame:
    """(doc_id, score, rank): the k nearest and the k best by words of an agent's documents, fused by rank.

    ``docs`` is what the agent may see; with ``agent`` only its own documents take part.
    """
    own = docs.filter(F.col("agent") == agent) if agent is not None else docs
    near = R.nearest(vectors.join(own.select("doc_id"), "doc_id", "left_semi"), query_vector, k, "doc_id")
    words = R.full_text(own.select("doc_id", "text"), query).orderBy(F.desc("score"), "doc_id").limit(k)
    fused = R.rrf(R.with_rank(near, F.desc("sim"), F.asc("doc_id")), R.with_rank(words, F.desc("score"), F.asc("doc_id")), "doc_id")
    found = fused.orderBy(F.desc_nulls_last("score"), "doc_id").limit(k)
    return R.with_rank(found, F.desc_nulls_last("score"), F.asc("doc_id"))


def two_passes(
    search: Callable[[str, list[float], int], DataFrame], query: str, query_vector: list[float], limit: int, stop_words: list[str],
    embed: Callable[[str], list[float]] | None = None,
) -> DataFrame:
    """(doc_id, score): pseudo-relevance feedback. The ten most frequent words of the five best hits of
    ``search`` (query, vector, limit) extend the query, which is embedded again and searched a second time;
    the higher score of either pass counts. Only the ten words come to the driver.
    """
    first = search(query, query_vector, 3 * limit)
    words = R.expansion_terms(first.orderBy(F.desc("score"), "doc_id").limit(5), stop_words).orderBy(F.desc("n"), "term").collect()
    longer = " ".join([query, *(r.term for r in words)])
    second = search(longer, embed(longer) if embed else query_vector, 2 * limit)
    merged = R.merge_best(first.select("doc_id", "score"), second.select("doc_id", "score"))
    return merged.orderBy(F.desc("score"), "doc_id").limit(limit)


def context_pack(hits: DataFrame, entities: DataFrame, edges: DataFrame, words: str, budget: int, most: int = 5) -> DataFrame:
    """One envelope for a prompt as rows (section, rank, id, name, tokens): documents that fit the budget of
    tokens, in order; the ``most`` longest-named entities that match a word of ``words``; and the ``most``
    surest relations (doc_id, relation_id, name, confidence) of the documents packed.

    ``hits`` (doc_id, text, rank) is a bounded list; the rest is limited by top-ks.
    """
    packed = R.token_budget(hits, budget)
    documents = packed.select(F.lit("document").alias("section"), F.col("rank").cast("long").alias("rank"), F.col("doc_id").cast("string").alias("id"),
                              F.left("text", F.lit(40)).alias("name"), "tokens")
    hit = None
    for word in words.lower().split():
        hit = F.lower("name").contains(word) if hit is None else hit | F.lower("name").contains(word)
    some = entities.filter(hit).orderBy(F.desc(F.length("name")), "entity_id").limit(most)
    some = R.with_rank(some, F.desc(F.length("name")), F.asc("entity_id"))
    named = some.select(F.lit("entity").alias("section"), F.col("rank").cast("long").alias("rank"), F.col("entity_id").cast("string").alias("id"), "name", F.lit(None).cast("long").alias("tokens"))
    order = [F.desc("confidence"), F.asc("doc_id"), F.asc("relation_id")]
    near = edges.join(F.broadcast(packed.select("doc_id")), "doc_id", "left_semi").orderBy(*order).limit(most)
    near = R.with_rank(near, *order)
    related = near.select(F.lit("relation").alias("section"), F.col("rank").cast("long").alias("rank"), F.col("relation_id").cast("string").alias("id"), "name", F.lit(None).cast("long").alias("tokens"))
    return documents.unionByName(named).unionByName(related)


def purged(tables: dict[str, DataFrame], gone: dict[str, DataFrame], references: dict[str, dict[str, str]], keys: dict[str, str]) -> dict[str, DataFrame]:
    """What is left of ``tables`` when rows go, and with them all rows that refer to these, through any depth.

    ``gone``: for a table, one column of its keys to delete. ``references``: for a table, its columns and the
    tables they point to, parents before children. ``keys``: the key column of each table others point to.
    Null references hold no row back and delete none.
    """
    dead, left = {}, {}
    for name, rows in tables.items():
        lost = [(column, dead[parent]) for column, parent in references.get(name, {}).items() if parent in dead]
        if name in gone:
            lost.append((keys[name], gone[name].toDF("_gone")))
        left[name] = rows
        fallen = []
        for column, ids in lost:
            on = F.col(column) == F.col("_gone")
            left[name] = left[name].join(ids, on, "left_anti")
            if name in keys:
                fallen.append(rows.join(ids, on, "left_semi").select(F.col(keys[name]).alias("_gone")))
        if fallen:
            dead[name] = reduce(DataFrame.union, fallen).distinct()
    return left
