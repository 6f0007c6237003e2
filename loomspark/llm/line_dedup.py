"""Operator 8: line dedup by pairwise alignment.

Documents overlap where they share a block: consecutive lines with ``min_words`` words or more. Every block
is covered by its shortest parts of that many words, so these are what is hashed (128 bits) and looked up:
mostly single lines, and runs of lines where lines are short. Each shared part leads to the earliest
document that holds it. That is one pair a part at most, so parts in very many documents need no cut-off
by document frequency: a rare one and a frequent one cost the same. A pair is aligned by patience diff:
parts that stand once on both sides, the longest increasing run of their positions, and the equal parts
around each of them; where none stands once on both sides, by a longest common subsequence. Parts that
stay unaligned are tried with the next holders in turn, until each is aligned or has met all its earlier
holders. A document aligns a part at least with every holder it tries, so its parts bound the holders it
tries, however many there are. Aligned parts are deleted from the later document; as each of them is whole
in one earlier document, no block is put together from several.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import WORD, materialise, scratch, slices

#: Blocks of fewer words stay.
MIN_WORDS = 8
#: Bits of a table of common subsequences; larger problems are halved first.
TABLE_BITS = 1 << 27
#: Most holders of a line that one round tries; rounds start with one and double.
MOST_HOLDERS = 512

_SPACE, _FIND = " \t\n\v\f\r", re.compile(WORD)


def least_blocks(text: str, min_words: int) -> list[tuple[int, int, bytes]]:
    """(first line, last line, key) of the shortest runs of lines with ``min_words`` words or more, one from
    each line on and one up to each line. Lines are split at \\n and compared without outer white space;
    those without a word are passed over: between two lines of a run they belong to it."""
    stripped = [(pos, line.strip(_SPACE)) for pos, line in enumerate(text.split("\n"))]
    lines = [(pos, line, len(_FIND.findall(line))) for pos, line in stripped if line]
    runs, end, words = [], 0, 0
    for start in range(len(lines)):
        while words < min_words and end < len(lines):
            words += lines[end][2]
            end += 1
        if words < min_words:
            break
        runs.append((start, end))
        words -= lines[start][2]
    known, start, words = set(runs), 0, 0
    for end, (_, _, count) in enumerate(lines, 1):
        words += count
        while words - lines[start][2] >= min_words:
            words -= lines[start][2]
            start += 1
        if words >= min_words and (start, end) not in known:
            runs.append((start, end))
    key = lambda a, b: blake2b("\n".join(x[1] for x in lines[a:b]).encode("utf-8"), digest_size=16).digest()
    return [(lines[a][0], lines[b - 1][0], key(a, b)) for a, b in sorted(runs)]


def _parts(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, tid, pos, first, last, key): the shortest blocks of each text, in order; tid tells texts apart."""
    docs = docs.filter("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tid"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = [least_blocks(t, min_words) for t in rows.column("text").to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                made = [pa.array([k for x in found for k in range(len(x))], pa.int32())]
                made += [pa.array([part[c] for x in found for part in x], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
                columns = [rows.column(c).take(at) for c in ("doc_id", "tid")]
                yield pa.RecordBatch.from_arrays(columns + made, ["doc_id", "tid", "pos", "first", "last", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, tid bigint, pos int, first int, last int, key binary")


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at:
            back[i] = piles[at - 1]
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _lcs_rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each start of ``a`` a bit row over ``b``: a 0 where the common subsequence grows by one."""
    at: dict[int, int] = {}
    for j, key in enumerate(b):
        at[key] = at.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    yield row
    for key in a:
        hit = row & at.get(key, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def common_subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions (i, j) of a longest common subsequence, in rows of bits; halved while the table is large."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [(0, b.index(a[0]))] if a[0] in b else []
    if len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        *_, low = _lcs_rows(a[:half], b)
        *_, high = _lcs_rows(a[:half - 1:-1], b[::-1])
        # the cut of b where both halves together have most in common
        fore, back = ([0, *accumulate(c == "0" for c in f"{row:0{len(b)}b}"[::-1])] for row in (low, high))
        cut = max(range(len(b) + 1), key=lambda j: fore[j] + back[len(b) - j])
        rest = common_subsequence(a[half:], b[cut:])
        return common_subsequence(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in rest]
    rows = list(_lcs_rows(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def aligned(later: list, earlier: list) -> list[int]:
    """Positions in ``later`` that a patience diff aligns with ``earlier`` (lists of keys)."""
    matched: dict[int, int] = {}
    stack = [(0, len(later), 0, len(earlier))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and later[a0] == earlier[b0]:  # equal heads
            matched[a0] = b0
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and later[a1 - 1] == earlier[b1 - 1]:  # equal tails
            a1, b1 = a1 - 1, b1 - 1
            matched[a1] = b1
        if a0 >= a1 or b0 >= b1:
            continue
        once: dict[int, list[int]] = {}
        for side, keys, start, end in ((0, later, a0, a1), (2, earlier, b0, b1)):
            for i in range(start, end):
                entry = once.setdefault(keys[i], [0, -1, 0, -1])
                entry[side] += 1
                entry[side + 1] = i
        common = sorted((e[1], e[3]) for e in once.values() if e[0] == 1 and e[2] == 1)
        run = [common[i] for i in increasing([b for _, b in common])]
        if not run:
            matched.update((a0 + i, b0 + j) for i, j in common_subsequence(later[a0:a1], earlier[b0:b1]))
            continue
        edges = [(a0 - 1, b0 - 1), *run, (a1, b1)]
        for (p, q), (r, s) in zip(edges, edges[1:], strict=False):
            if r < a1:
                matched[r] = s
            stack.append((p + 1, r, q + 1, s))
    return sorted(matched)


def _aligned(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, tid, hit, left) for parts to align (doc_id, tid, pos, key, partner) and those of the partners
    (partner, key, pos): parts aligned with a partner, and those aligned with none.

    A document's partners are tried from the earliest on, each with the parts still unaligned then.
    """
    entries = F.sort_array(F.collect_set(F.struct("partner", "pos", "key")))
    later = pairs.groupBy("doc_id", "tid").agg(entries.alias("later"))
    # the earlier side: its parts that some later document shares, once a pair
    wanted = pairs.select("doc_id", "tid", "partner", "key").distinct()
    earlier = wanted.join(held, ["partner", "key"]).groupBy("doc_id", "tid").agg(entries.alias("earlier"))
    both = later.join(earlier, ["doc_id", "tid"])
    kind = pairs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, rest = [], []
            for later, earlier in zip(batch.column("later"), batch.column("earlier"), strict=True):
                theirs = {p: [x["key"] for x in some] for p, some in groupby(earlier.as_py(), lambda x: x["partner"])}
                hit, last = {}, {}
                for partner, some in groupby(later.as_py(), lambda x: x["partner"]):
                    some = [x for x in some if (x["pos"], x["key"]) not in hit]
                    for i in aligned([x["key"] for x in some], theirs[partner]):
                        hit[some[i]["pos"], some[i]["key"]] = some[i]
                    last.update(((x["pos"], x["key"]), x) for x in some)
                hits.append([hit[k] for k in sorted(hit)])
                rest.append([x for k, x in last.items() if k not in hit])
            kind = batch.column("later").type
            columns = [batch.column("doc_id"), batch.column("tid"), pa.array(hits, kind), pa.array(rest, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "hit", "left"])

    part = f"array<struct<partner: {kind}, pos: int, key: binary>>"
    return both.mapInArrow(run, f"doc_id {kind}, tid bigint, hit {part}, left {part}")


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, tid, deleted): sorted positions of the lines to delete, for texts that lose any."""
    with scratch(docs.sparkSession) as keep:
        parts = keep(_parts(docs, min_words))
        # the earliest holder of each part that several documents hold
        held = parts.groupBy("key").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest")).filter("earliest < latest")
        shared = keep(parts.join(keep(held.drop("latest")), "key"))
        partners = shared.select(F.col("doc_id").alias("partner"), "key", "pos")
        pairs = shared.filter("doc_id > earliest").select("doc_id", "tid", "pos", "key", F.col("earliest").alias("partner"))
        tried = keep(_aligned(pairs, shared.filter("doc_id = earliest").select(F.col("doc_id").alias("partner"), "key", "pos")))
        found, most = [tried], 1
        while not tried.isEmpty():
            # what is left goes on to the holders after the last one tried, which is the same for a part everywhere
            left = tried.select("doc_id", "tid", F.explode("left").alias("l")).select("doc_id", "tid", "l.pos", "l.key", "l.partner")
            after = keep(left.groupBy("key").agg(F.max("partner").alias("after"), F.max("doc_id").alias("latest")))
            later = shared.join(after, "key").filter("doc_id > after AND doc_id < latest").select("key", F.col("doc_id").alias("partner")).distinct()
            nth = F.row_number().over(Window.partitionBy("key").orderBy("partner"))
            holders = keep(later.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth"))
            most = min(2 * most, MOST_HOLDERS)
            pairs = left.drop("partner").join(holders, "key").filter("doc_id > partner")
            tried = keep(_aligned(pairs, partners.join(holders, ["partner", "key"])))
            found.append(tried)
        hits = reduce(DataFrame.unionByName, found).select("doc_id", "tid", F.explode("hit").alias("x")).select("doc_id", "tid", "x.pos").distinct()
        hits = shared.select("doc_id", "tid", "pos", "first", "last").distinct().join(hits, ["doc_id", "tid", "pos"])
        lines = F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.sequence("first", "last")))))
        return materialise(hits.groupBy("doc_id", "tid").agg(lines.alias("deleted")))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the aligned blocks gone from ``text``, plus n_lines and n_deleted (long).

    The document with the smaller doc_id keeps a block. Documents that lose nothing keep their text to
    the byte, null and empty ones too; a document that loses every line has an empty text. Rows that
    repeat a doc_id are aligned one by one, but no row of an id deletes lines from another row of it; to
    later documents they are one. Rows with a null doc_id stay as they are. Of
    equal partners the earliest counts, and of equally long alignments the one that a patience diff meets
    first. Texts of any length are read whole. An empty table gives an empty result. Columns n_lines and
    n_deleted of the input are replaced; other columns stay.
    """
    docs = docs.drop("n_lines", "n_deleted")
    gone = deletions(docs.select("doc_id", "text"), min_words).withColumnsRenamed({"doc_id": "_id", "deleted": "_deleted", "tid": "_tid"})
    # the deletions grow with the documents: a merge join at every size
    out = docs.join(gone.hint("merge"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_tid")), "left")
    kept = F.expr(
        "transform(array(split(text, '\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), _deleted), i -> l[i]), '\n'))[0]"
    )
    return out.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
            "n_deleted": F.coalesce(F.size("_deleted"), F.lit(0)).cast("long"),
            "text": F.when(F.col("_deleted").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("_deleted", "_id", "_tid")
