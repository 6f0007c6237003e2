"""The whole context pack: documents within a budget, entities, people, notes, relations, metadata, envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import confidence_band
from loomspark.operators import ranking as R

#: Rows of a section at most, and the modes in which a line may be shown.
MOST = {"entity": 10, "person": 10, "note": 5}
MODES = ("silent", "ambient", "audit")


def heartbeat(mode: Column, facts: Column) -> Column:
    """The line that may be shown: none in silent mode or without facts."""
    line = F.format_string('%d %s used. Ask "why" to see sources.', facts, F.when(facts == 1, "fact").otherwise("facts"))
    return F.when((mode != "silent") & (facts > 0), line)


def envelope(hits: DataFrame, mode: str) -> DataFrame:
    """One row: mode, fact_count, confidence_band, source_type_count, source_types (type -> n), heartbeat of ``hits``
    (score, type), a bounded list. Without hits it counts none and has no band."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    by = hits.groupBy("type").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    types = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("type").cast("string"), "n"))))
    facts = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return by.agg(
        F.lit(mode).alias("mode"), facts.alias("fact_count"), confidence_band(F.sum("s") / F.sum("n")).alias("confidence_band"), F.count("*").alias("source_type_count"),
        types.alias("source_types"), heartbeat(F.lit(mode), facts).alias("heartbeat"),
    )


def matching(rows: DataFrame, phrase: str, names: list[str], id: str, most: int, aliases: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """The first ``most`` rows that hold ``phrase`` in a name, in any case, or have it as an alias, as it is."""
    found = F.lit(False)
    for name in names:
        found = found | F.coalesce(F.lower(name).contains(phrase.lower()), F.lit(False))
    if aliases:
        found = found | F.coalesce(F.array_contains(aliases, phrase), F.lit(False))
    order = order or [F.asc(names[0]), F.asc(id)]
    return R.with_rank(rows.filter(found).orderBy(*order).limit(most), *order)


def pack(
    hits: DataFrame, entities: DataFrame, people: DataFrame, notes: DataFrame, edges: DataFrame, phrase: str, actor: str, budget: int, mode: str = "ambient", relations: int = 20
) -> DataFrame:
    """(section, rank, id, name, detail): what a prompt is given for ``phrase``; detail is JSON.

    ``hits`` (doc_id, text, type, score, created_at, rank) is a bounded list and is cut to the token budget.
    Entities (entity_id, name, aliases) and people (person_id, name, email) match by name, alias or address,
    the notes (note_id, agent, content, created_at) of ``actor`` by content, latest first. Relations are the
    surest edges (canonical columns) at any document, entity or person packed. Then a row of metadata about
    the documents and the envelope. Texts of the documents are not cut further than the budget asks.
    """
    json = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    section = lambda df, name, id, shown, detail: df.select(
        F.lit(name).alias("section"), F.col("rank").cast("long").alias("rank"), id.cast("string").alias("id"), shown.alias("name"), detail.alias("detail")
    )
    packed = R.token_budget(hits, budget).cache()
    ents = matching(entities, phrase, ["name"], "entity_id", MOST["entity"], "aliases")
    folk = matching(people, phrase, ["name", "email"], "person_id", MOST["person"])
    own = notes.filter(F.col("agent") == actor)
    said = matching(own, phrase, ["content"], "note_id", MOST["note"], order=[F.desc("created_at"), F.asc("note_id")])
    node = lambda df, kind, id: df.select(F.lit(kind).alias("kind"), F.col(id).cast("string").alias("id"))
    seeds = node(packed, "doc", "doc_id").unionByName(node(ents, "entity", "entity_id")).unionByName(node(folk, "person", "person_id"))
    ends = None
    for here in ("src", "dst"):  # a bounded list of seeds
        on = F.broadcast(seeds.select(F.col("kind").alias(f"{here}_kind"), F.col("id").alias(f"_{here}")))
        at = edges.withColumn(f"_{here}", F.col(here).cast("string")).join(on, [f"{here}_kind", f"_{here}"], "left_semi").select(edges.columns)
        ends = at if ends is None else ends.unionByName(at)
    order = [F.desc("confidence"), F.asc("kind"), F.asc("src"), F.asc("dst"), F.asc("predicate")]
    near = R.with_rank(ends.distinct().orderBy(*order).limit(relations), *order)
    everything = packed.withColumn("type", F.col("type").cast("string"))
    meta = R.result_metadata(everything).withColumn("rank", F.lit(1))
    env = envelope(everything, mode).withColumn("rank", F.lit(1))
    none = F.lit(None).cast("string")
    parts = [
        section(packed, "document", F.col("doc_id"), F.left("text", F.lit(40)), json(F.col("tokens"), F.col("truncated"))),
        section(ents, "entity", F.col("entity_id"), F.col("name"), json(F.coalesce(F.col("aliases"), F.array().cast("array<string>")).alias("aliases"))),
        section(folk, "person", F.col("person_id"), F.col("name"), json(F.col("email"))),
        section(said, "note", F.col("note_id"), F.left("content", F.lit(40)), json(F.col("agent"))),
        section(near, "relation", F.concat_ws(":", "src_kind", "src"), F.col("predicate"), json(F.col("kind"), F.concat_ws(":", "dst_kind", "dst").alias("to"))),
        section(meta, "metadata", none, none, json(F.col("hits"), F.col("documents"), F.col("by_type"))),
        section(env, "envelope", none, F.col("heartbeat"), json("mode", "fact_count", "confidence_band", "source_type_count", "source_types")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
