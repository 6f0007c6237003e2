"""Operator 13: fill-in-the-middle. Cut a text into prefix, middle and suffix and put the middle last.

A text is cut into units: code points, words or lines. The unit and code-point counts of fixed blocks of its
UTF-8 bytes stand in a Fenwick tree. A cut after so many units descends that tree by powers of two to the
block that holds it and finds the boundary inside that block only; the same descent gives the code points
before it. What is drawn at random comes from the hash of a seed and the document's id, so reruns agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.shared import slices

#: Bytes a block of the tree has.
BLOCK = 1024
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Of 100 texts, those left plain and, of the others, those that begin with their suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


def points(data: np.ndarray) -> np.ndarray:
    """Where a code point begins: every byte but continuation bytes."""
    return (data & 0xC0) != 0x80


def unit_starts(data: np.ndarray, unit: str, start: int = 0, end: int | None = None) -> np.ndarray:
    """Where in data[start:end] a unit begins. Units tile the text: one begins at its start, and one at each
    code point, behind each line feed, or at each word's first byte; one byte of context decides."""
    part = data[max(start - 1, 0) : end]
    if unit == "code_point":
        first = points(part)
    elif unit == "line":
        first = np.ones(len(part), bool)
        first[1:] = part[:-1] == 10
    elif unit == "word":
        space = (part == 0x20) | ((part >= 9) & (part <= 13))
        first = np.ones(len(part), bool)
        first[1:] = ~space[1:] & space[:-1]
    else:
        raise ValueError("unit must be code_point, word or line")
    return first[1:] if start else first


@dataclass
class BlockTree:
    """Fenwick tree over blocks of bytes: row 0 sums units, row 1 code points."""

    data: np.ndarray
    unit: str
    sums: np.ndarray  # (2, blocks + 1); place 0 is unused
    units: int

    @classmethod
    def of(cls, data: np.ndarray, unit: str) -> BlockTree:
        edges = np.arange(0, len(data), BLOCK)
        counts = [np.add.reduceat(x(data), edges, dtype=np.int64) for x in (lambda d: unit_starts(d, unit), points)]
        sums = np.zeros((2, len(edges) + 1), np.int64)
        sums[:, 1:] = counts
        total = int(counts[0].sum())
        step = 1
        while step <= len(edges):  # every node passes its sum to its parent, level by level
            child = np.arange(step, len(edges) + 1, 2 * step)
            child = child[child + step <= len(edges)]
            sums[:, child + step] += sums[:, child]
            step *= 2
        return cls(data, unit, sums, total)

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first k units."""
        if k >= self.units:
            place, chars = self.sums.shape[1] - 1, 0
            while place:  # prefix sum over all blocks
                chars, place = chars + int(self.sums[1, place]), place & (place - 1)
            return len(self.data), chars
        # the largest run of whole blocks with at most k units: unit k + 1 begins in the block behind it
        place, before, chars = 0, 0, 0
        step = 1 << (self.sums.shape[1] - 1).bit_length()
        while step:
            at = place + step
            if at < self.sums.shape[1] and before + self.sums[0, at] <= k:
                place, before, chars = at, before + int(self.sums[0, at]), chars + int(self.sums[1, at])
            step >>= 1
        start = place * BLOCK
        inside = int(np.flatnonzero(unit_starts(self.data, self.unit, start, start + BLOCK))[k - before])
        return start + inside, chars + int(points(self.data[start : start + inside]).sum())


def draws(seed: str, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: bytes, key: str, unit: str, seed: str) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    data = np.frombuffer(text, np.uint8)
    tree = BlockTree.of(data, unit) if len(data) else None
    n = tree.units if tree else 0
    h = draws(seed, key)
    if not n or any(m in text for m in MARKS) or h[2] % 100 >= 100 - PLAIN_PERCENT:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    (a, before), (b, upto) = tree.cut(low), tree.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h[3] % 100 < SPM_PERCENT:
        return n, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = "code_point", seed: str = "1") -> DataFrame:
    """Add n (units), form, prefix_chars, middle_chars (code points; null if plain) and output to ``docs``.

    A null text counts as empty and gives the plain form with an empty output; a null id is drawn as the
    empty string. Texts with a mark stay plain, as they could not be told apart again. Repeated rows get
    equal results. Columns of the names added are replaced, all others stay; an empty table gives an empty
    one. Each text is read whole, one at a time.
    """
    names = [c for c in docs.columns if c not in ADDED]
    docs = docs.select(*(F.col(f"`{c}`") for c in names), F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("_fim_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw = part.column(text).cast(pa.binary()).to_pylist()
                made = [transformed(t or b"", k, unit, seed) for t, k in zip(raw, part.column("_fim_key").to_pylist(), strict=True)]
                n, form, before, middle, out = zip(*made, strict=True)
                added = [pa.array(n, pa.int64()), pa.array(form), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
                added[-1] = pc.cast(added[-1], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], [*names, *ADDED])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1]] + [f"{c} {kind}" for c, kind in ADDED.items()]
    return docs.mapInArrow(run, ", ".join(fields))


def restored(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made: a JVM expression over the three marks."""
    between = lambda left, right: F.substring_index(F.substring_index(output, right, 1), left, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: The query's rows; needs one seed, "1", and code points as units.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
