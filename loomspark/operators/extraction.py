"""Extraction of entities from text through a pluggable extractor, and the normal form of its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.numbers import clamp
from loomspark.functions.text import capitalised, clean_aliases, clean_name, predicate_name

ENTITY = "array<struct<name: string, kind: string, aliases: array<string>, confidence: double>>"


def by_capitals(text: Column) -> Column:
    """The deterministic extractor: capitalised tokens; those that begin with Orgz are organisations."""
    organisation = lambda n: n.startswith("Orgz")
    return F.transform(
        capitalised(text),
        lambda n: F.struct(
            n.alias("name"), F.when(organisation(n), "organization").otherwise("concept").alias("kind"),
            F.array().cast("array<string>").alias("aliases"), F.when(organisation(n), 0.9).otherwise(0.55).alias("confidence"),
        ),
    )


def normal_entities(found: Column) -> Column:
    """Trimmed names, default kind, clean aliases, confidence in 0..1 (0.5 if unknown); nameless ones go."""
    clean = F.transform(
        found,
        lambda e: F.struct(
            clean_name(e["name"]).alias("name"), F.coalesce(F.lower(clean_name(e["kind"])), F.lit("concept")).alias("kind"),
            clean_aliases(e["aliases"]).alias("aliases"), clamp(e["confidence"], 0.5).alias("confidence"),
        ),
    )
    return F.filter(clean, lambda e: e["name"].isNotNull())


def normal_relations(found: Column) -> Column:
    """Trimmed ends, normal predicate, confidence in 0..1; relations that lack a part go."""
    clean = F.transform(
        found,
        lambda r: F.struct(
            clean_name(r["subject"]).alias("subject"), F.nullif(predicate_name(r["predicate"]), F.lit("")).alias("predicate"),
            clean_name(r["object"]).alias("object"), clamp(r["confidence"], 0.5).alias("confidence"),
        ),
    )
    return F.filter(clean, lambda r: r["subject"].isNotNull() & r["predicate"].isNotNull() & r["object"].isNotNull())


def entities(chunks: DataFrame, extractor: Callable[[Column], Column] = by_capitals, id: str = "doc_id") -> DataFrame:
    """(id, name, kind, confidence). ``extractor`` maps a text column to an array of entities; a model runs
    as a pandas UDF of that type."""
    found = chunks.select(id, F.explode(normal_entities(extractor(F.col("text")))).alias("e"))
    return found.select(id, "e.name", "e.kind", "e.confidence")


def missing_endpoints(entities: DataFrame, relations: DataFrame, id: str = "doc_id", most: int = 8) -> DataFrame:
    """(id, key, name): ends of relations (id, position, subject, object) that are no name or alias of the
    document's entities (id, name, aliases), whatever the case, spelled as at their first place.

    A second look at a text asks for at most ``most`` names, the first ones, ties by spelling; ends of one character or null
    are no names. Null aliases count as none.
    """
    named = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = entities.select(id, F.explode(named).alias("key")).select(id, F.lower("key").alias("key")).distinct()
    ends = F.explode(F.array(*(F.struct(F.struct("position", F.lit(n)).alias("at"), F.trim(c).alias("name")) for n, c in enumerate(("subject", "object")))))
    asked = relations.select(id, ends.alias("e")).select(id, "e.*", F.lower("e.name").alias("key")).filter(F.length("key") >= 2)
    first = asked.groupBy(id, "key").agg(F.min(F.struct("at", "name")).alias("f"))
    place = F.row_number().over(Window.partitionBy(id).orderBy("f.at", "key"))
    lacking = first.join(known, [id, "key"], "left_anti").withColumn("place", place).filter(F.col("place") <= most)
    return lacking.select(id, "key", "f.name")


def with_recovered(entities: DataFrame, found: DataFrame, asked: DataFrame, id: str = "doc_id") -> DataFrame:
    """Entities and those of ``found`` (the same columns) whose name was asked for: one for each name, of
    the highest confidence; names that the document has already are not added."""
    key = F.lower("name").alias("key")
    new = found.withColumn("key", key).join(asked.select(id, "key"), [id, "key"], "left_semi")
    new = new.join(entities.select(id, key).distinct(), [id, "key"], "left_anti")
    rest = [c for c in entities.columns if c != id]
    best = new.groupBy(id, "key").agg(F.max_by(F.struct(*rest), F.struct("confidence", "name")).alias("e"))
    return entities.withColumn("recovered", F.lit(False)).unionByName(best.select(id, "e.*", F.lit(True).alias("recovered")))
