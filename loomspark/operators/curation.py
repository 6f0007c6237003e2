"""The write path as set operations: append-only facts and derived current states, never updates.

Idempotency, deduplication and state changes are anti-joins and windows over keys; each batch gives the
rows to append and the rows it rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.numbers import clamp
from loomspark.functions.text import clean_aliases, clean_name, predicate_name, sanitize, type_name
from loomspark.operators.evidence import compounded, strongest_per_source
from loomspark.operators.lineage import cut


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("sha256", F.sha2(sanitize(F.col("text")), 256))


def ingest(batch: DataFrame, stored: DataFrame | None = None, keys: tuple[str, ...] = ("workspace", "sha256"), id: str = "doc_id") -> DataFrame:
    """Add ``deduped``: true if the key is stored already or an earlier row of the batch has it.

    The first id of a key is a minimum with a map-side combine; only rows that repeat an id are numbered.
    """
    first = batch.groupBy(*keys).agg(F.min(id).alias("_first"))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    out = batch.alias("b").join(first.alias("f"), on).select("b.*", "_first")
    again = F.row_number().over(Window.partitionBy(*keys, id).orderBy(id)) > 1
    out = out.withColumn("deduped", ~F.col(id).eqNullSafe(F.col("_first")) | again).drop("_first")
    if stored is not None:
        known = stored.select(*keys).distinct().withColumn("_known", F.lit(True))
        out = out.join(known, list(keys), "left").withColumn("deduped", F.col("deduped") | F.coalesce("_known", F.lit(False))).drop("_known")
    return out


def first_rule(docs: DataFrame, rules: DataFrame, id: str = "doc_id") -> DataFrame:
    """The rule of highest priority (lowest number) that fits each document.

    In rules (rule_id, priority, mime_type, name_contains) a null pattern fits all. A document meets the
    rules of its type and those of any by an equi-join, so no side has to be small.
    """
    either = docs.withColumn("_m", F.explode(F.array(F.col("mime_type"), F.lit(None).cast("string"))))
    fits = F.col("_m").eqNullSafe(F.col("r.mime_type")) & (F.col("r.name_contains").isNull() | F.lower("d.name").contains(F.lower("r.name_contains")))
    best = F.min(F.struct("r.priority", "r.rule_id"))
    found = either.alias("d").join(rules.alias("r"), fits).groupBy(f"d.{id}").agg(best.alias("b"))
    return found.select(id, "b.rule_id")


def visible(docs: DataFrame, actor: str, service: bool = False, llm: bool = False) -> DataFrame:
    """Private documents (sharing 1) are seen by their agent and the service only; a null sharing is not
    private. The llm role sees workspace, public and llm-readable documents only (2, 4, 5)."""
    see = ~F.col("sharing").eqNullSafe(F.lit(1)) | F.coalesce(F.col("agent") == actor, F.lit(False)) | F.lit(service)
    return docs.filter(see & (F.coalesce(F.col("sharing").isin(2, 4, 5), F.lit(False)) if llm else F.lit(True)))


def write_once(events: DataFrame, keys: list[str], *order: Column) -> tuple[DataFrame, DataFrame]:
    """(first write of each idempotency key, replays)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = events.withColumn("_r", F.row_number().over(w))
    return numbered.filter("_r = 1").drop("_r"), numbered.filter("_r > 1").drop("_r")


def valid_envelopes(events: DataFrame) -> DataFrame:
    """Add ``problem``: what makes a write envelope invalid, or null."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    problem = F.when(blank("idempotency_key"), "idempotency_key").when(blank("trace_id"), "trace_id").when(blank("kind"), "kind")
    return events.withColumn("problem", problem)


def unique_triples(triples: DataFrame) -> DataFrame:
    """One row for each (subject, predicate, object) by normal form, the most confident."""
    out = triples.withColumns(
        {"subject": clean_name(F.col("subject")), "predicate": predicate_name(F.col("predicate")), "object": clean_name(F.col("object"))}
    ).filter("subject IS NOT NULL AND object IS NOT NULL")
    out = out.withColumns({"s": F.lower("subject"), "o": F.lower("object")}).filter("s <> o")
    return out.groupBy("s", "predicate", "o").agg(F.max(clamp(F.col("confidence"), 0.5)).alias("confidence"))


def promote(proposals: DataFrame, kinds: DataFrame, threshold: float = 0.6, strict: bool = False) -> DataFrame:
    """Add ``state``: promoted if confident enough and of a kind in the catalog, and not in strict mode."""
    known = kinds.select(F.col("kind").alias("_k")).distinct()
    out = proposals.join(known, F.col("kind") == F.col("_k"), "left")
    ok = (F.col("confidence") >= threshold) & F.col("_k").isNotNull() & F.lit(not strict)
    return out.withColumn("state", F.when(ok, "promoted").otherwise("pending")).drop("_k")


def sub_phrases(names: DataFrame) -> DataFrame:
    """(kind, name, phrase): the proper leading and trailing word sequences of each name."""
    words = F.split("name", " ")
    count = F.size(words)
    parts = F.flatten(
        F.transform(F.sequence(F.lit(1), count - 1), lambda n: F.array(F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, -n, n), " ")))
    )
    return names.filter(count > 1).select("kind", "name", F.explode(F.array_distinct(parts)).alias("phrase"))


def resolve_names(names: DataFrame) -> DataFrame:
    """(kind, name, canonical): names of one kind join the longest name that begins or ends with them.

    An equi-join of each name to the phrases of longer ones. The map is followed to its fixed point: each
    round doubles the steps and each step leads to a longer name, so the rounds grow with the logarithm
    of the nesting. Rounds are cut by checkpoints.
    """
    names = names.select("kind", F.lower(F.trim(F.col("name"))).alias("name")).distinct()
    longer = sub_phrases(names).withColumnRenamed("name", "longer").withColumnRenamed("phrase", "name")
    best = names.join(longer, ["kind", "name"]).groupBy("kind", "name")
    best = best.agg(F.max_by("longer", F.struct(F.length("longer"), F.col("longer"))).alias("canonical"))
    out = names.join(best, ["kind", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    out = cut(out)
    while True:
        step = out.filter("name <> canonical").select("kind", F.col("name").alias("canonical"), F.col("canonical").alias("_next"))
        out = cut(out.join(step, ["kind", "canonical"], "left").select("kind", "name", F.coalesce("_next", "canonical").alias("canonical"), "_next"))
        if out.filter("_next IS NOT NULL").isEmpty():
            return out.drop("_next")
        out = out.drop("_next")


def resolve_endpoints(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Names to entity ids by two equi-joins; unresolved and self edges go."""
    by = entities.select(F.lower("name").alias("_n"), "entity_id").dropDuplicates(["_n"])
    out = triples.join(by.withColumnRenamed("entity_id", "subject_id"), F.lower("subject") == F.col("_n")).drop("_n")
    out = out.join(by.withColumnRenamed("entity_id", "object_id"), F.lower("object") == F.col("_n")).drop("_n")
    return out.filter("subject_id <> object_id")


def schema_proposals(observed: DataFrame, catalog: DataFrame, floor: float = 0.6) -> DataFrame:
    """Novel types seen at or above ``floor``: (name, seen_count by distinct source, confidence)."""
    seen = observed.filter(F.col("confidence") >= floor).withColumn("name", type_name(F.col("name"))).filter("name IS NOT NULL")
    new = seen.join(catalog.select(type_name(F.col("name")).alias("name")).distinct(), "name", "left_anti")
    return new.groupBy("name").agg(F.greatest(F.lit(1), F.count_distinct("source")).cast("long").alias("seen_count"), F.max("confidence").alias("confidence"))


def promote_types(proposals: DataFrame, catalog: DataFrame, seen: int = 3, confidence: float = 0.8, strict: bool = False) -> DataFrame:
    """Eligible proposals with the id of an existing type of that normal form, or the next free ids.

    Numbering runs over eligible proposals only, which a review table bounds.
    """
    fit = proposals.filter((F.col("seen_count") >= seen) & (F.col("confidence") >= confidence) & F.lit(not strict))
    have = catalog.select(type_name(F.col("name")).alias("name"), F.col("type_id").alias("_have")).dropDuplicates(["name"])
    top = catalog.agg(F.coalesce(F.max("type_id"), F.lit(0)).alias("_top"))
    out = fit.join(have, "name", "left").join(F.broadcast(top))  # one row
    fresh = F.row_number().over(Window.partitionBy(F.col("_have").isNull()).orderBy("name"))
    return out.select("name", "seen_count", "confidence", F.coalesce("_have", F.col("_top") + fresh).alias("type_id"), F.col("_have").isNotNull().alias("reused"))


def review(proposals: DataFrame, decisions: DataFrame, id: str = "proposal_id") -> DataFrame:
    """Apply the latest decision to pending proposals; reviewed ones are frozen."""
    last = decisions.groupBy(id).agg(F.max_by("decision", "decided_at").alias("_d"))
    state = F.when((F.col("state") == "pending") & (F.col("_d") == "approve"), "approved").when((F.col("state") == "pending") & (F.col("_d") == "reject"), "rejected")
    return proposals.join(last, id, "left").withColumn("state", F.coalesce(state, "state")).drop("_d")


def approved_entities(proposals: DataFrame, entities: DataFrame, id: str = "proposal_id") -> DataFrame:
    """(id, entity_id, made) of approved proposals (id, name, kind, state): the entity that each stands for.

    One with the same name, whatever its case, and kind is taken as it is, the smallest id of several. Else
    one is made, once for all proposals of that name and kind; its id is a hash of these, so reruns agree.
    """
    key = [F.lower("name").alias("_n"), F.col("kind").alias("_k")]
    known = entities.groupBy(*key).agg(F.min("entity_id").alias("_e"))
    wanted = proposals.filter("state = 'approved'").select(id, *key)
    on = wanted["_n"].eqNullSafe(known["_n"]) & wanted["_k"].eqNullSafe(known["_k"])
    made = F.sha2(F.concat_ws("\n", wanted["_k"], wanted["_n"]), 256)
    return wanted.join(known, on, "left").select(id, F.coalesce(F.col("_e").cast("string"), made).alias("entity_id"), F.col("_e").isNull().alias("made"))


def approved_edges(proposals: DataFrame, entities: DataFrame, edges: DataFrame, id: str = "proposal_id") -> DataFrame:
    """Approved relations (id, subject, predicate, object, state) with ``outcome``: blocked while an end is
    no entity, kept if the edge is current, superfluous if a smaller id makes the same edge, else made.

    ``edges``: the current ones (subject, predicate, object), which may repeat. Null ends are blocked.
    """
    spo = ["subject", "predicate", "object"]
    wanted = proposals.filter("state = 'approved'").select(id, *spo)
    for end in ("subject", "object"):
        there = entities.select(F.col("entity_id").alias(end)).distinct().withColumn(f"_{end}", F.lit(True))
        wanted = wanted.join(there, end, "left")
    current = edges.select(*spo).distinct().withColumn("_edge", F.lit(True))
    first = wanted.groupBy(*spo).agg(F.min(id).alias("_first"))
    rows = wanted.join(current, spo, "left").join(first, spo, "left")
    outcome = F.when(F.col("_subject").isNull() | F.col("_object").isNull(), "blocked").when(F.col("_edge"), "kept").when(F.col(id) > F.col("_first"), "superfluous")
    return rows.select(id, *spo, outcome.otherwise("made").alias("outcome"))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The change log between two snapshots: (key, op, column, old_value, new_value) for each changed column."""
    o = old.select(F.col(key), F.struct(*columns).alias("_o"))
    n = new.select(F.col(key), F.struct(*columns).alias("_n"))
    both = o.join(n, key, "full_outer")
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").otherwise("update")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_o.{c}").cast("string").alias("old_value"), F.col(f"_n.{c}").cast("string").alias("new_value")) for c in columns))
    changed = F.filter(cells, lambda x: ~x["old_value"].eqNullSafe(x["new_value"]))
    return both.select(key, op.alias("op"), F.explode(changed).alias("c")).select(key, "op", "c.column", "c.old_value", "c.new_value")


def claim(queue: DataFrame, batch: int, attempts: int = 3, id: str = "chunk_id") -> DataFrame:
    """The oldest pending rows below the attempt cap, marked processing: a distributed top-k."""
    free = queue.filter((F.col("status") == "pending") & (F.col("attempts") < attempts))
    return free.orderBy("updated_at", id).limit(batch).withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1})


def reap(queue: DataFrame, as_of: Column, lease_minutes: int = 5, attempts: int = 3) -> DataFrame:
    """Stale processing rows go back to pending, or to failed once their attempts are used up."""
    stale = (F.col("status") == "processing") & (F.col("updated_at") < as_of - F.make_dt_interval(mins=F.lit(lease_minutes)))
    state = F.when(stale & (F.col("attempts") >= attempts), "failed").when(stale, "pending").otherwise(F.col("status"))
    return queue.withColumn("status", state)


def pending_list(entities: DataFrame, kinds: DataFrame, documents: DataFrame, most: int = 50) -> DataFrame:
    """Pending entity proposals (proposal_id, name, kind_id, confidence, state, doc_id) as a reviewer sees them, surest
    first: with the kind's name and the source document's, null where either is gone."""
    rows = entities.filter("state = 'pending'").orderBy(F.desc("confidence"), "proposal_id").limit(most)
    rows = rows.join(kinds.select("kind_id", F.col("name").alias("kind")), "kind_id", "left").join(documents.select("doc_id", F.col("name").alias("source")), "doc_id", "left")
    return rows.select("proposal_id", "name", "kind", F.round("confidence", 2).alias("confidence"), "source").orderBy(F.desc("confidence"), "proposal_id")


def mentions_of_approved(proposals: DataFrame, resolved: DataFrame, mentions: DataFrame, id: str = "proposal_id") -> DataFrame:
    """The mention rows (entity_id, doc_id, confidence) that approvals add: of each entity and source document the
    surest proposal's, where no mention is there yet. ``resolved`` is from :func:`approved_entities`."""
    rows = proposals.filter("doc_id IS NOT NULL").join(resolved.select(id, "entity_id"), id).groupBy("entity_id", "doc_id").agg(F.max(clamp(F.col("confidence"))).alias("confidence"))
    return rows.join(mentions.select(F.col("entity_id").cast("string").alias("entity_id"), "doc_id").distinct(), ["entity_id", "doc_id"], "left_anti")


def evidence_of_approved(proposals: DataFrame, outcomes: DataFrame, evidence: DataFrame, id: str = "proposal_id") -> tuple[DataFrame, DataFrame]:
    """(new evidence, rescored edges) of approved relations.

    Every approval that is not blocked is a sighting of its edge by its source document, which counts once an
    edge and document; so an approval of an edge that is there already strengthens it. Edges that gain
    evidence are scored again over all of theirs: (subject, predicate, object, sources, confidence).
    ``outcomes`` is from :func:`approved_edges`; evidence has subject, predicate, object, source, confidence.
    """
    spo = ["subject", "predicate", "object"]
    seen = outcomes.filter("outcome <> 'blocked'").select(id, *spo).join(proposals.select(id, F.col("doc_id").cast("string").alias("source"), "confidence"), id)
    seen = seen.groupBy(*spo, "source").agg(F.max(clamp(F.col("confidence"))).alias("confidence"))
    new = seen.join(evidence.select(*spo, "source").distinct(), [*spo, "source"], "left_anti")
    touched = new.select(*spo).distinct()
    every = evidence.select(*new.columns).join(touched, spo, "left_semi").unionByName(new)
    return new, compounded(strongest_per_source(every))


#: Fixed value: the confidence from which a proposal is promoted where a workspace does not say.
PROMOTE_FROM = 0.6


def promote_by_setting(proposals: DataFrame, kinds: DataFrame, settings: DataFrame) -> DataFrame:
    """:func:`promote` with the threshold of each proposal's workspace: settings (workspace, least), text or number.

    A setting that is missing or no number from 0 to 1 counts as 0.6. Adds ``threshold`` and ``state``.
    """
    own = settings.groupBy("workspace").agg(F.max(F.col("least").cast("string").try_cast("double")).alias("_t"))
    rows = proposals.join(own, "workspace", "left")
    rows = rows.withColumn("threshold", F.when(F.col("_t").between(0.0, 1.0), F.col("_t")).otherwise(PROMOTE_FROM)).drop("_t")
    known = kinds.select(F.col("kind").alias("_k")).distinct()
    rows = rows.join(known, F.col("kind") == F.col("_k"), "left")
    ok = (F.col("confidence") >= F.col("threshold")) & F.col("_k").isNotNull()
    return rows.withColumn("state", F.when(ok, "promoted").otherwise("pending")).drop("_k")


def proposed(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entity proposals, relation proposals, rejected) of agents' facts: workspace, agent, kind ("entity" or
    "relation"), name, entity_kind, aliases, subject, predicate, object, doc_id, confidence.

    Proposals stay pending, whatever their confidence, and name who made them. Their ids are hashes of what
    they say and who says it, so the same fact said twice is one proposal, with its highest confidence. A fact
    of another kind, or without what its kind needs, is rejected with its problem.
    """
    name, ends = clean_name(F.col("name")), (clean_name(F.col("subject").cast("string")), clean_name(F.col("object").cast("string")))
    lacks = F.when(F.col("kind") == "entity", F.when(name.isNull(), "name")).when(
        F.col("kind") == "relation", F.when(ends[0].isNull(), "subject").when(ends[1].isNull(), "object").when(clean_name(F.col("predicate")).isNull(), "predicate")
    )
    rows = facts.withColumn("problem", F.when(F.coalesce(F.col("kind").isin("entity", "relation"), F.lit(False)), lacks).otherwise("kind"))
    good = rows.filter("problem IS NULL").withColumns({"made_by": F.concat(F.lit("agent:"), "agent"), "confidence": clamp(F.col("confidence"), 0.5), "name": name, "predicate": predicate_name(F.col("predicate"))})

    def once(kind: str, says: list[str], rest: list[str]) -> DataFrame:
        own = good.filter(F.col("kind") == kind).withColumns({c: F.col(c).cast("string") for c in says})
        key = ["workspace", "made_by", *says]
        id = F.sha2(F.concat_ws("|", F.lit(kind), *(F.coalesce(c, F.lit("")) for c in key)), 256)
        kept = own.groupBy(*key).agg(F.max("confidence").alias("confidence"), *(F.min(c).alias(c) for c in rest))
        return kept.select(id.alias("proposal_id"), *key, *rest, "confidence", F.lit("pending").alias("state"))

    entities = once("entity", ["name", "entity_kind"], ["aliases", "doc_id"])
    entities = entities.withColumn("aliases", clean_aliases(F.col("aliases")))
    return entities, once("relation", ["subject", "predicate", "object"], ["doc_id"]), rows.filter("problem IS NOT NULL").select("workspace", "agent", "kind", "problem")


def aliases_of(resolved: DataFrame) -> DataFrame:
    """(kind, canonical, aliases): the other names of each entity, from :func:`resolve_names`, in order."""
    others = F.array_sort(F.collect_set(F.when(F.col("name") != F.col("canonical"), F.col("name"))))
    return resolved.groupBy("kind", "canonical").agg(others.alias("aliases"))


def processed(docs: DataFrame) -> DataFrame:
    """Documents whose processing is done: only these are searched."""
    return docs.filter(F.col("state") == "done")
