"""Where what is known comes from: pairs and single subjects, for one of them or for a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(asked: DataFrame, spans: DataFrame, mentions: DataFrame) -> DataFrame:
    """(a, b, section, predicate, confidence, valid_from, valid_to, doc_id, n_a, n_b) of each asked pair (a, b).

    ``spans`` (subject, object, predicate, confidence, valid_from, valid_to) in either direction are direct,
    or superseded once they have an end. ``mentions`` (entity_id, doc_id) give the documents that mention
    both, with how often. A pair of a node with itself has no shared documents.
    """
    pair = asked.select("a", "b").distinct()
    direct = None
    for one, two in (("a", "b"), ("b", "a")):
        at = spans.join(pair.select(F.col(one).alias("subject"), F.col(two).alias("object"), "a", "b"), ["subject", "object"])
        direct = at if direct is None else direct.unionByName(at.filter("a <> b"))
    kind = F.when(F.col("valid_to").isNull(), "direct").otherwise("superseded")
    none = F.lit(None).cast("long")
    direct = direct.select("a", "b", kind.alias("section"), "predicate", "confidence", "valid_from", "valid_to", none.alias("doc_id"), none.alias("n_a"), none.alias("n_b"))
    counts = mentions.groupBy("entity_id", "doc_id").agg(F.count("*").alias("n"))
    a = counts.join(pair.filter("a <> b").select(F.col("a").alias("entity_id"), "b"), "entity_id").select(F.col("entity_id").alias("a"), "b", "doc_id", F.col("n").alias("n_a"))
    both = a.join(counts.select(F.col("entity_id").alias("b"), "doc_id", F.col("n").alias("n_b")), ["b", "doc_id"])
    text, number, time = (F.lit(None).cast(direct.schema[c].dataType) for c in ("predicate", "confidence", "valid_from"))
    shared = both.select("a", "b", F.lit("shared").alias("section"), text.alias("predicate"), number.alias("confidence"), time.alias("valid_from"), time.alias("valid_to"), F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b")
    return direct.unionByName(shared)


def proposals_of(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entity and relation proposals as one list: (kind, proposal_id, name, state, confidence, doc_id)."""
    one = entities.select(F.lit("entity").alias("kind"), "proposal_id", "name", "state", "confidence", "doc_id")
    verb = F.concat_ws(" ", F.col("subject").cast("string"), "predicate", F.col("object").cast("string"))
    return one.unionByName(relations.select(F.lit("relation").alias("kind"), "proposal_id", verb.alias("name"), "state", "confidence", "doc_id"))


def subjects(asked: DataFrame, named: DataFrame, trail: DataFrame, proposals: DataFrame, documents: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, section, at, detail) of each asked subject (id): itself, its trail in time, the proposals and the ingest
    of its documents, and the evidence it is an end of.

    named: id, name. trail: id, at, change. proposals: as from :func:`proposals_of`. documents: id (of the
    subject), doc_id, at, source, state. evidence: source, target, predicate, source_doc, at. A subject of
    which nothing is known gives no row; no list is gathered in one row.
    """
    own = asked.select("id").distinct()
    row = lambda df, name, at, detail: df.select("id", F.lit(name).alias("section"), at.alias("at"), detail.alias("detail"))
    never = F.lit(None).cast(trail.schema["at"].dataType)
    docs = documents.join(own, "id").select("id", "doc_id", "at", "source", "state")
    out = row(named.join(own, "id"), "subject", never, F.col("name"))
    out = out.unionByName(row(trail.join(own, "id"), "trail", F.col("at"), F.col("change")))
    out = out.unionByName(row(docs, "ingest", F.col("at"), F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "state")))
    proposed = docs.select("id", "doc_id").distinct().join(proposals, "doc_id")
    out = out.unionByName(row(proposed, "proposal", never, F.concat_ws(" ", "kind", F.col("proposal_id").cast("string"), "state")))
    for here, there in (("source", "target"), ("target", "source")):
        at = evidence.withColumn("id", F.col(here)).join(own, "id")
        at = at if here == "source" else at.filter(~F.col("source").eqNullSafe(F.col("target")))
        out = out.unionByName(row(at, "evidence", F.col("at"), F.concat_ws(" ", F.lit(here), "predicate", F.col(there).cast("string"))))
    return out
