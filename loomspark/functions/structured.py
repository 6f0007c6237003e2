"""Chunking by paragraphs, repair of truncated JSON, redaction and name-based ids."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def paragraph_chunks(text: Column, most: int = 1000, overlap: int = 150) -> Column:
    """Paragraphs packed greedily into chunks of up to ``most`` characters.

    A text that fits is one chunk as it stands. A new chunk begins with the last ``overlap`` characters of
    the one before; a paragraph is never split. One aggregate over the paragraphs, inside the JVM.
    """
    gap = F.lit("\n\n")
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    tail = lambda c: F.when(F.length(c) > overlap, F.right(c, F.lit(overlap))).otherwise(c)
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def step(s: Column, p: Column) -> Column:
        full = (F.length(s["at"]) > 0) & (F.length(s["at"]) + F.length(p) + 2 > most)
        longer = F.when(s["at"] == "", p).otherwise(F.concat(s["at"], gap, p))
        return F.when(full, state(F.concat(tail(s["at"]), gap, p), F.array_append(s["out"], trim(s["at"])))).otherwise(state(longer, s["out"]))

    def end(s: Column) -> Column:
        last = trim(s["at"])
        return F.when(last != "", F.array_append(s["out"], last)).when(F.size(s["out"]) > 0, s["out"]).otherwise(F.array(text))

    packed = F.aggregate(F.split(text, "\n\n+"), state(F.lit(""), F.array().cast("array<string>")), step, end)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


#: What matters in broken JSON: an escaped character, a quote, a bracket.
_MARKS = re.compile(r"""\\.|["\[\]{}]""", re.S)
_CLOSER = str.maketrans("{[", "}]")


def close_json(text: str | None) -> str | None:
    """Cut a truncated document after its last complete object or array, and close what is open there.

    Marks are read in order: those between two quotes are text, the others nest. ``nest`` holds the
    brackets open so far; a closing one outside of text is a place where the document could end.
    """
    if text is None:
        return None
    nest, inside, place, rest = "", False, 0, ""
    for mark in _MARKS.finditer(text):
        kind = mark[0]
        inside ^= kind == '"'
        if inside or len(kind) == 2 or kind == '"':
            continue
        if kind in "{[":
            nest += kind
        else:
            nest = nest[:-1]
            place, rest = mark.end(), nest
    return text[:place] + rest[::-1].translate(_CLOSER) if place else text


def repaired_json(text: Column) -> Column:
    """:func:`close_json` in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(close_json)

    return F.pandas_udf(run, "string")(text)


#: Fixed value: keys whose values never reach a log.
SENSITIVE = r"(?i)^(api_key|apikey|.*_secret|.*_token|password)$"


def redacted(entries: Column) -> Column:
    """A map with the values of sensitive keys replaced."""
    return F.transform_values(entries, lambda k, v: F.when(k.rlike(SENSITIVE), "[REDACTED]").otherwise(v))


def name_uuid(namespace: str, name: Column) -> Column:
    """The version 5 uuid of a name in a namespace (a uuid text)."""
    space = bytearray.fromhex(namespace.replace("-", ""))
    digest = F.sha1(F.concat(F.lit(bytes(space)), F.encode(name, "UTF-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant.cast("long"))), F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )
