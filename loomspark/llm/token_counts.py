"""Operator 5: token counts by field or section, from one encoding of the whole document.

A document is encoded once; token lengths give each token's byte span. Sections are character spans.
Both lists are sorted, so each token finds its sections by binary search inside the document's own row:
the interval join needs no shuffle. A token that crosses a boundary is allocated by a named rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bpe import ByteBpe, codec, default_vocabulary
from loomspark.llm.shared import slices

#: "first": the section with the token's first byte. "majority": the one with most of its bytes, the
#: earlier one if equal. "share": each section gets the share of the token's bytes that lies in it.
BOUNDARY_RULES = ("first", "majority", "share")


def line_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``section_lengths`` in characters: one section a line, with its \\n. Null for a null text."""
    lengths = "transform(l, (x, i) -> CAST(length(x) AS BIGINT) + if(i < size(l) - 1, 1, 0))"
    return docs.withColumn("section_lengths", F.expr(f"transform(array(split({text}, '\n')), l -> {lengths})[0]"))


def field_sections(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """Add ``text``, the named columns joined by ``separator`` (nulls as empty), and their lengths.

    A separator counts with the field before it.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    last = len(fields) - 1
    lengths = [(F.length(p) + (0 if k == last else len(separator))).cast("long") for k, p in enumerate(parts)]
    return df.withColumns({"text": F.concat_ws(separator, *parts), "section_lengths": F.array(*lengths)})


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, crossing tokens that touch it) for byte offsets; both tile the same bytes.

    Several texts may stand one after the other, as no token reaches from one into the next. Empty
    sections hold no byte: the search passes over them.
    """
    count = len(section_ends)
    if not len(token_ends) or not count:
        return np.zeros(count), np.zeros(count, np.int64)
    starts = np.concatenate([[0], token_ends[:-1]])
    section_starts = np.concatenate([[0], section_ends[:-1]])
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends - 1, side="right")
    inside = first == last
    tokens = np.bincount(first[inside], minlength=count).astype(np.float64)
    # one row for each crossing token and section from its first to its last one
    across = np.flatnonzero(~inside)
    spans = last[across] - first[across] + 1
    begin = np.cumsum(spans) - spans
    token = np.repeat(np.arange(len(across)), spans)
    section = first[across][token] + np.arange(len(token)) - begin[token]
    ends, starts = token_ends[across], starts[across]
    overlap = np.minimum(section_ends[section], ends[token]) - np.maximum(section_starts[section], starts[token])
    crossing = np.bincount(section[overlap > 0], minlength=count)
    if rule == "share":
        tokens += np.bincount(section, overlap / (ends - starts)[token], minlength=count)
    elif rule == "first":
        tokens += np.bincount(first[across], minlength=count)
    elif len(across):
        most = np.maximum.reduceat(overlap, begin)
        # of equal overlaps the earlier section: the first row of the token that has the most
        best = np.flatnonzero(overlap == most[token])
        tokens += np.bincount(section[best[np.unique(token[best], return_index=True)[1]]], minlength=count)
    return tokens, crossing


def _lengths(path: str, pattern: str) -> tuple[ByteBpe, np.ndarray]:
    """The codec and the bytes of each token, once a worker."""
    bpe, decoder = codec(path, pattern)
    if not hasattr(bpe, "lengths"):
        bpe.lengths = np.zeros(max(bpe.tokens) + 1, np.int64)
        bpe.lengths[list(bpe.tokens)] = [len(x) for x in bpe.tokens.values()]
    return bpe, bpe.lengths


def _part(bpe: ByteBpe, length: np.ndarray, texts: pa.Array, sizes: pa.Array, rule: str) -> tuple[np.ndarray, ...]:
    """(row, section, n_chars, n_tokens, n_crossing) of some texts with a section or more, worked out
    together: their bytes stand one after the other, and so do their characters, tokens and sections."""
    words = texts.to_pylist()
    data = b"".join(w.encode("utf-8") for w in words)
    count = np.array(pc.list_value_length(sizes).to_numpy(zero_copy_only=False), np.int64)
    flat = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.array([len(w) for w in words], np.int64)
    row = np.repeat(np.arange(len(words)), count)
    # ends of the sections in characters of their own text; the last one takes what is left
    last = np.cumsum(count) - 1
    running = np.cumsum(flat)
    before = np.concatenate([[0], running])[np.cumsum(count) - count]
    ends = np.minimum(running - before[row], chars[row])
    ends[last] = chars
    base = np.cumsum(chars) - chars
    # byte offsets of characters
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    offset = np.append(starts, len(data))
    section_ends = offset[ends + base[row]]
    ids = np.frombuffer(b"".join(bpe.packed(w) for w in words), "<u4")
    token_ends = np.cumsum(length[ids])
    n, c = allocate(token_ends, section_ends, rule)
    start = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    before = np.where(start > 0, np.concatenate([[0], ends[:-1]]), 0) if len(ends) else ends
    return row, start, ends - before, n, c


def attribute(docs: DataFrame, rule: str = "majority", text: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each section of each row of ``docs`` (``text``, ``section_lengths`` in characters).

    Returns the other columns, section (int, from 0), n_chars (long), n_tokens (long; double for the rule
    "share") and n_crossing (long: boundary-crossing tokens that touch the section). The n_tokens of a row
    add up to the tokens of its whole text. Sections tile the text: characters past the last one belong
    to it. A null text, null or no lengths give no row, an empty text its sections with no token, an empty
    table an empty result. Repeated rows give repeated results; columns of the names added are replaced.
    A text of any length is encoded whole, in one row; lengths past the end of the text count as 0.
    """
    if rule not in BOUNDARY_RULES:
        raise ValueError(f"rule must be one of {BOUNDARY_RULES}")
    path, pattern = vocabulary or default_vocabulary()
    docs = docs.drop("section", "n_chars", "n_tokens", "n_crossing").filter(F.col(text).isNotNull() & (F.size("section_lengths") > 0))
    keep = [f for f in docs.schema.fields if f.name not in (text, "section_lengths")]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, length = _lengths(path, pattern)
        for batch in batches:
            for part in slices(batch, text):
                row, section, chars, tokens, crossing = _part(bpe, length, part.column(text), part.column("section_lengths"), rule)
                at = pa.array(row)
                made = [
                    pa.array(section, pa.int32()), pa.array(chars, pa.int64()),
                    pa.array(tokens if rule == "share" else tokens.astype(np.int64)), pa.array(crossing, pa.int64()),
                ]
                columns = [part.column(n).take(at) for n in names] + made
                yield pa.RecordBatch.from_arrays(columns, [*names, "section", "n_chars", "n_tokens", "n_crossing"])

    kinds = f"section int, n_chars bigint, n_tokens {'double' if rule == 'share' else 'bigint'}, n_crossing bigint"
    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [kinds]))
