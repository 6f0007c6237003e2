"""JSON of any shape as Spark's VARIANT: parsing, reading, listing, setting and merging, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = "map<string,variant>"


def parsed(json: Column) -> Column:
    """Null for null and for what is no JSON."""
    return F.try_parse_json(json)


def read(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path such as ``$.a.b[0]`` as ``kind``; null if it is missing or of another kind."""
    return F.try_variant_get(value, path, kind)


def first_of(value: Column, paths: list[str], kind: str = "string") -> Column:
    """The first of several paths that has a value: one name stands for another."""
    return F.coalesce(*(read(value, p, kind) for p in paths))


def fields(value: Column) -> Column:
    """The fields of an object; an empty map for anything else."""
    return F.coalesce(F.try_variant_get(value, "$", FIELDS), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))


def with_field(value: Column, path: list[str], new: Column) -> Column:
    """``value`` with the field at ``path`` set to the variant ``new``; objects on the way are made, anything else there is replaced."""
    head, rest = path[0], path[1:]
    inner = F.try_variant_get(value, f"$['{head}']", "variant") if rest else None
    set_to = with_field(inner, rest, new) if rest else new
    kept = F.map_filter(fields(value), lambda k, _: k != head)
    return F.to_variant_object(F.map_concat(kept, F.create_map(F.lit(head), set_to)))


def merged(left: Column, right: Column) -> Column:
    """The fields of both objects; of one that both have, the right one's."""
    names = F.map_keys(fields(right))
    kept = F.map_filter(fields(left), lambda k, _: ~F.array_contains(names, k))
    return F.to_variant_object(F.map_concat(kept, fields(right)))


def listed(rows: DataFrame, value: str, *keep: str) -> DataFrame:
    """A row for each field of an object: the kept columns, key and value (variant)."""
    return rows.select(*keep, F.explode(fields(F.col(value))).alias("key", "value"))
