"""Neighbours of documents, entities, agents and people by the rules of what is visible and what is current.

A read is a union of branches, each one equi-join of an edge table to the roots; an edge that may meet a root
at either end is two of them. Roots are a table, so one call serves one node or all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.curation import visible

COLUMNS = ["branch", "root_kind", "root", "edge_id", "from_kind", "from_id", "to_kind", "to_id", "predicate", "relation_type", "confidence", "created_at"]
#: What the edges without a predicate of their own are called.
MENTIONS, MENTIONED_IN, OWNS = "mentions", "mentioned_in", "owns_memory"
#: Which node wins where a name is known for more than one kind: the last one.
PRECEDENCE = ("doc", "entity", "person")


@dataclass
class Memory:
    """Tables of edges and documents; ids of one kind share a type, and all are compared as strings."""

    documents: DataFrame  # doc_id, agent, sharing, created_at
    doc_docs: DataFrame  # edge_id, doc1, doc2, relation_type, priority, confidence, created_at
    doc_people: DataFrame  # edge_id, person, doc, relation_type, confidence, created_at, valid_to
    mentions: DataFrame  # edge_id, entity, doc, confidence, created_at
    entity_edges: DataFrame  # edge_id, entity1, entity2, predicate, confidence, created_at, valid_to
    people_people: DataFrame  # edge_id, person1, person2, relation_type, confidence, created_at, end_date
    evidence: DataFrame  # edge_id, kind, source, target, predicate, confidence, created_at


def _at(edges: DataFrame, roots: DataFrame, kind: str, column: str) -> DataFrame:
    """Edges whose ``column`` is a root of that kind."""
    own = roots.filter(F.col("kind") == kind).select(F.col("id").alias("root"))
    return edges.withColumn("root", F.col(column).cast("string")).join(own, "root").withColumn("root_kind", F.lit(kind))


def _either(edges: DataFrame, roots: DataFrame, kind: str, one: str, two: str) -> DataFrame:
    """Edges with a root at either end, an edge from a root to itself once."""
    return _at(edges, roots, kind, one).unionByName(_at(edges.filter(~F.col(one).eqNullSafe(F.col(two))), roots, kind, two))


def _edges(rows: DataFrame, branch: str, start: tuple[str, str], end: tuple[str, str], predicate: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    own = predicate if predicate is not None else F.col("predicate") if "predicate" in rows.columns else none
    kind = F.col("relation_type").cast("string") if "relation_type" in rows.columns else none
    id = lambda c: F.col(c).cast("string")
    made = [F.lit(branch), F.col("root_kind"), F.col("root"), id("edge_id"), F.lit(start[0]), id(start[1]), F.lit(end[0]), id(end[1]), own, kind, F.col("confidence").cast("double"), F.col("created_at")]
    order = F.col("priority") if "priority" in rows.columns else F.lit(None).cast("int")
    return rows.select(*(c.alias(n) for c, n in zip(made, COLUMNS, strict=True)), order.alias("_priority"))


def neighbors(
    memory: Memory, roots: DataFrame, as_of: Column, actor: str, limit: int | None = None, relation_types: list | None = None, service: bool = False
) -> DataFrame:
    """Edges (COLUMNS) at the ``roots`` (kind doc, entity, agent or person; id).

    A document has its related documents, its people and the entities it mentions; an entity its relations
    and the documents that mention it; an agent its documents, the memories it has evidence of and its
    edges with agents; a person its documents and people. Of people's and entities' edges only those count
    that are valid at ``as_of``; documents that ``actor`` may not see are neither owned nor mentioned in.
    ``relation_types`` narrows the edges that have a type. ``limit`` keeps the first of each root and
    branch: related documents by priority, then confidence; others latest first; ties by edge id, and
    by the ends, predicate, type and confidence where edges share an id.
    """
    roots = roots.select("kind", F.col("id").cast("string").alias("id")).distinct()
    typed: Callable[[DataFrame], DataFrame] = lambda e: e.filter(F.col("relation_type").isin(relation_types)) if relation_types is not None else e
    valid = lambda e, end="valid_to": e.filter(F.col(end).isNull() | (F.col(end) > as_of))
    m, seen = memory, visible(memory.documents, actor, service)
    people, entities, persons = valid(typed(m.doc_people)), valid(m.entity_edges), valid(typed(m.people_people), "end_date")
    readable = m.mentions.join(seen.select(F.col("doc_id").alias("doc")).distinct(), "doc", "left_semi")
    owned = seen.select(F.col("doc_id").alias("edge_id"), "agent", "doc_id", F.lit(1.0).alias("confidence"), "created_at")
    told = lambda kind: m.evidence.filter(F.col("kind") == kind).drop("kind")
    found = [
        _edges(_either(typed(m.doc_docs), roots, "doc", "doc1", "doc2"), "doc_doc", ("doc", "doc1"), ("doc", "doc2")),
        _edges(_at(people, roots, "doc", "doc"), "doc_person", ("doc", "doc"), ("person", "person")),
        _edges(_at(m.mentions, roots, "doc", "doc"), "doc_entity", ("doc", "doc"), ("entity", "entity"), F.lit(MENTIONS)),
        _edges(_either(entities, roots, "entity", "entity1", "entity2"), "entity_entity", ("entity", "entity1"), ("entity", "entity2")),
        _edges(_at(readable, roots, "entity", "entity"), "entity_doc", ("entity", "entity"), ("doc", "doc"), F.lit(MENTIONED_IN)),
        _edges(_at(owned, roots, "agent", "agent"), "agent_doc", ("agent", "agent"), ("doc", "doc_id"), F.lit(OWNS)),
        _edges(_at(told("agent_memory"), roots, "agent", "source"), "agent_memory", ("agent", "source"), ("doc", "target")),
        _edges(_either(told("agent_agent"), roots, "agent", "source", "target"), "agent_agent", ("agent", "source"), ("agent", "target")),
        _edges(_at(people, roots, "person", "person"), "person_doc", ("person", "person"), ("doc", "doc")),
        _edges(_either(persons, roots, "person", "person1", "person2"), "person_person", ("person", "person1"), ("person", "person2")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if limit is not None:
        order = [F.desc_nulls_last("_priority"), F.when(F.col("branch") == "doc_doc", F.col("confidence")).desc_nulls_last(), F.desc_nulls_last("created_at"), F.asc("edge_id")]
        # edges may share an id: without their values the layout would decide which of them stays
        order += ["from_id", "to_id", "predicate", "relation_type", F.desc_nulls_last("confidence")]
        place = F.row_number().over(Window.partitionBy("branch", "root_kind", "root").orderBy(*order))
        out = out.withColumn("_r", place).filter(F.col("_r") <= limit).drop("_r")
    return out.select(*COLUMNS)


def nodes(edges: DataFrame, roots: DataFrame, names: DataFrame) -> DataFrame:
    """(kind, id, name) of all ends of ``edges`` and the roots, once each. ``names`` has kind, id and name.

    A node has the name of its kind and id; else, as ids may stand for several kinds, the name that the kind
    of highest PRECEDENCE has for the id; else none, and an agent then its id with a label.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_kind").alias("kind"), F.col("from_id").alias("id")), F.struct(F.col("to_kind").alias("kind"), F.col("to_id").alias("id")))).alias("n"))
    every = ends.select("n.*").unionByName(roots.select("kind", F.col("id").cast("string").alias("id"))).distinct()
    names = names.select("kind", F.col("id").cast("string").alias("id"), "name")
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    best = names.groupBy("id").agg(F.max_by("name", F.struct(rank, "name")).alias("_any"))
    own = names.groupBy("kind", "id").agg(F.min("name").alias("_own"))
    out = every.join(own, ["kind", "id"], "left").join(best, "id", "left")
    label = F.when(F.col("kind") == "agent", F.concat(F.lit("agent "), F.left("id", F.lit(8))))
    return out.select("kind", "id", F.coalesce("_own", F.when(F.col("kind") != "agent", F.col("_any")), label).alias("name"))
