"""Reads over a canonical edge table (kind, src_kind, src, dst_kind, dst, predicate, confidence).

An edge that may match at either end is read as the union of two equi-joins, never as a join with OR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.lineage import cut

EDGE_COLUMNS = ["kind", "src_kind", "src", "dst_kind", "dst", "predicate", "confidence"]


def canonical(*tables: DataFrame) -> DataFrame:
    """One edge table from several; each brings the canonical columns."""
    out = tables[0].select(*EDGE_COLUMNS)
    for more in tables[1:]:
        out = out.unionByName(more.select(*EDGE_COLUMNS))
    return out


def directed(edges: DataFrame, seeds: DataFrame, direction: str = "both") -> DataFrame:
    """Edges at the seeds (kind, id), seen from them: adds root, other_kind, other and direction."""
    ends = []
    if direction in ("out", "both"):
        ends.append(("src", "dst", "out"))
    if direction in ("in", "both"):
        ends.append(("dst", "src", "in"))
    found = None
    for here, there, way in ends:
        at = edges.join(seeds.select(F.col("kind").alias(f"{here}_kind"), F.col("id").alias(here)), [f"{here}_kind", here])
        at = at.select(*EDGE_COLUMNS, F.col(here).alias("root"), F.col(f"{there}_kind").alias("other_kind"), F.col(there).alias("other"), F.lit(way).alias("direction"))
        found = at if found is None else found.unionByName(at)
    return found


def related(
    edges: DataFrame, seeds: DataFrame, direction: str = "both", least: float = 0.0, kinds: list[str] | None = None, predicates: list[str] | None = None
) -> DataFrame:
    """Edges at the seeds with at least that confidence, to nodes of the kinds and of the predicates asked for.

    What does not depend on the seeds is filtered before the joins, so that it reaches the scan.
    """
    rows = edges.filter(F.col("confidence") >= least)
    rows = rows if predicates is None else rows.filter(F.col("predicate").isin(predicates))
    found = directed(rows, seeds, direction)
    return found if kinds is None else found.filter(F.col("other_kind").isin(kinds))


def hops(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(kind, id, hop): nodes within k steps, edges taken both ways, each at its least distance.

    A hop reads the edges at its frontier only, and the nodes it reaches are a checkpoint: the plan of a
    hop does not grow with the hops before it.
    """
    seen = cut(seeds.select("kind", "id").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, k + 1):
        reached = None
        for here, there in (("src", "dst"), ("dst", "src")):
            at = front.select(F.col("kind").alias(f"{here}_kind"), F.col("id").alias(here))
            found = edges.select("src_kind", "src", "dst_kind", "dst").join(at, [f"{here}_kind", here], "left_semi")
            found = found.select(F.col(f"{there}_kind").alias("kind"), F.col(there).alias("id"))
            reached = found if reached is None else reached.unionByName(found)
        front = cut(reached.distinct().join(seen.select("kind", "id"), ["kind", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def with_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Left join of (kind, id) to (kind, id, name); a node without a name keeps its id."""
    return nodes.join(names, ["kind", "id"], "left").withColumn("name", F.coalesce("name", F.col("id").cast("string")))


def sharing_entity(mentions: DataFrame, subject) -> DataFrame:
    """Documents that mention an entity which the subject document mentions: (doc_id, shared)."""
    own = mentions.filter(F.col("doc_id") == subject).select("entity_id").distinct()
    other = mentions.filter(F.col("doc_id") != subject).select("doc_id", "entity_id").distinct()
    return other.join(own, "entity_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("shared"))


def shared_documents(mentions: DataFrame, a, b) -> DataFrame:
    """Documents that mention both entities: (doc_id, n_a, n_b), the counts of their mentions."""
    both = mentions.filter(F.col("entity_id").isin(a, b)).groupBy("doc_id")
    both = both.agg(F.count_if(F.col("entity_id") == a).alias("n_a"), F.count_if(F.col("entity_id") == b).alias("n_b"))
    return both.filter("n_a > 0 AND n_b > 0")


def latest_changes(edges: DataFrame, changes: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """The n latest change rows of each edge."""
    w = Window.partitionBy(*key).orderBy(*order)
    return changes.join(edges.select(*key).distinct(), key, "left_semi").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)


def trace(events: DataFrame, trace_id: str, time: str, id: str) -> DataFrame:
    """Events of each trace numbered in time, each with the id of the one before it."""
    w = Window.partitionBy(trace_id).orderBy(time, id)
    return events.withColumns({"step": F.row_number().over(w), "previous": F.lag(id).over(w)})
