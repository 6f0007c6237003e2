"""Operator 10: exact n-gram Jaccard join by set-relation skipping.

Documents become sets of shingle hashes. Equal sets are one class. Two classes whose similarity reaches
the threshold must share a shingle among the first few of either one, in any order that all sets agree
on; shingles known to be frequent come last in that order, the rest stand by hash. The first few of every
class form index lists, and relations between sets keep these lists from being read in full:

* answers by increments: every class is compared with one set, the most central one that its lists name.
  Where the two are at least half alike it keeps that set as its pivot and, instead of itself, only its
  difference from the pivot. For two sets x, y with differences X, Y from a pivot p,
  |x & y| = |p| - |p - x| - |p - y| + |X & Y|, so all answers among the sets of one pivot follow from what
  the pivot's own answers gave: many are certain from the first three terms, the others read only the
  small differences. They are worked out in tiles of bounded size, in numpy, and no list is read;
* blocks by position: what is left are pairs of different pivots. Their lists are cut into blocks by size;
  the smaller set of a pair goes only into those blocks whose sizes its position in the list can still
  reach, so the later it stands the more blocks skip it. Entries behind which too few shingles are left
  are passed over, and pairs that can still reach the threshold are compared on their whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from loomspark.llm.shared import connected_components, materialise, scratch, slices, worker_table

WORDS, PERCENT = 5, 75
#: A shingle that so many sets hold counts as frequent, if an Arrow slice holds it twice somewhere.
OFTEN = 12
#: Bits of the filter that tells frequent shingles, and how many of them (the most frequent) it may hold.
FILTER_BITS = 1 << 23
MOST_FREQUENT = FILTER_BITS // 16
#: Bytes of text whose shingles are counted together.
COUNTED_TOGETHER = 4 << 20
#: Least similarity, in percent, to the pivot that a set is derived from.
PIVOT_PERCENT = 50
#: Sets and bytes of differences in one block of a tile; a tile compares two blocks.
BLOCK_ROWS, BLOCK_BYTES = 512, 2 << 20
#: Blocks by size in one step of the least ratio of sizes that can match.
STEPS = 4
#: Above all orders of size that differences have.
TIED = 64
#: Bits of the filter of documents to verify: 2 MB. More documents than an eighth of it are joined instead.
DOCUMENT_BITS = 1 << 24

_SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
#: Texts are hashed together up to so many bytes; the tables of powers cover them.
_TOGETHER = 1 << 17


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Values of bytes (A-Z as a-z, white space 0), powers of the base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        self.space = np.zeros(256, bool)
        self.space[_SPACES] = True
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.value[65:91] = self.value[97:123]
        self.value[_SPACES] = 0
        self.factors = rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
        self.size = 0

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.size < n:
            self.size = max(2 * n, _TOGETHER)
            self.up, self.down = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.size, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))
            )
        return self.up[:n], self.down


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles, A-Z folded; int64.

    A word's hash is a polynomial over its bytes, taken for all words at once from running sums and
    then mixed; a shingle's hash is a mixed linear form of those of its words. With fewer words than a
    shingle has, the whole sequence is one shingle; without words there is none.
    """
    out: list[np.ndarray] = []
    together: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8")
        if together and size + len(data) > _TOGETHER:
            out += _hashed(together, words)
            together, size = [], 0
        together.append(data)
        size += len(data) + 1
    return out + (_hashed(together, words) if together else [])


def _hashed(texts: list[bytes], words: int) -> list[np.ndarray]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    tables = worker_table("jaccard", words, _Tables)
    up, down = tables.powers(len(raw))
    space = tables.space[raw]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        turns = np.concatenate([[0], turns])
    starts, ends = turns[::2], turns[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum(tables.value[raw] * up, dtype=np.uint64)])
    word = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    linear = word * tables.factors[0]
    for k in range(1, words):
        linear[: len(word) - k] += word[k:] * tables.factors[k]
    shingle = _mix(linear).view(np.int64)
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    found = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = last - first
        if n >= words:
            some = np.sort(shingle[first : last - words + 1])
            found.append(some[np.concatenate([[True], some[1:] != some[:-1]])])
        elif n:  # the whole sequence, told apart from others by its length
            short = (word[first:last] * tables.factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
            found.append(_mix(np.array([short])).view(np.int64))
        else:
            found.append(np.zeros(0, np.int64))
    return found


def class_of(hashes: np.ndarray) -> int | None:
    """A 64-bit name of the set; None for the empty one."""
    if not len(hashes):
        return None
    mixed = _mix(hashes.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(_mix(np.array([mixed])).view(np.int64)[0])


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n can decide: n - ceil(percent n / 100) + 1."""
    return n - -(-percent * n // 100) + 1


def _need(a: Column, b: Column, percent: int) -> Column:
    """Least intersection of sets of sizes a and b that reaches the threshold, in whole numbers."""
    return F.ceil((F.lit(percent) * (a + b)) / F.lit(100.0 + percent) - F.lit(1e-9)).cast("int")


def _bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits from a column ``slot``: at most bits / 64 rows come to the driver."""
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = slots.select(F.shiftright("slot", 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit"))
    got = words.toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64)
    return table


def _in_table(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((table[slots >> 6] >> (slots & 63)) & 1).astype(bool)


def _frequent(docs: DataFrame, words: int, keep: Callable[[DataFrame], DataFrame]) -> np.ndarray:
    """Bit filter of the shingles that many sets hold, over the whole table.

    A slice tells only the shingles that it holds twice or more, so what is shuffled is small; the filter
    takes the most frequent ones that it has room for. The order of shingles needs no more than to be the
    same everywhere, so this touches speed alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNTED_TOGETHER):
                hashes = np.concatenate(shingle_sets(part.column("text").to_pylist(), words))
                hashes.sort()
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                counts = np.diff(np.append(first, len(hashes)))
                some = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first[some]]), pa.array(counts[some])], ["h", "n"])

    seen = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    seen = keep(seen.filter(F.col("n") >= OFTEN).select("h", F.floor(F.log2("n")).cast("int").alias("level")))
    room, least = MOST_FREQUENT, 99
    for level, count in seen.groupBy("level").count().orderBy(F.desc("level")).collect():  # 63 rows at most
        room -= count
        if room < 0:
            break
        least = level
    # the slot of a hash read as unsigned: the filter's size is a power of two
    return _bit_table(seen.filter(F.col("level") >= least).select(F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")), FILTER_BITS)


def _sets(docs: DataFrame, words: int, percent: int, table: np.ndarray) -> DataFrame:
    """(doc_id, n, class, rare, first): class names the set, first holds its first shingles in the order,
    of which so many as rare says are not known to be frequent.

    Of the documents of one class that a task meets, only the first carries ``first``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 1 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            for part in slices(batch, "text"):
                names, sizes, rare, firsts = [], [], [], []
                for hashes in shingle_sets(part.column("text").to_pylist(), words):
                    n, name = len(hashes), class_of(hashes)
                    sizes.append(n)
                    names.append(name)
                    if not n or name in met:
                        firsts.append(None)
                        rare.append(None)
                        continue
                    met.add(name)
                    often = _in_table(shared.value, (hashes.view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64))
                    order = np.concatenate([hashes[~often], hashes[often]]) if often.any() else hashes
                    firsts.append(order[: int(_prefix(n, percent))])
                    rare.append(n - int(often.sum()))
                columns = [pa.array(sizes, pa.int32()), pa.array(names, pa.int64()), pa.array(rare, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n", "class", "rare", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n int, class bigint, rare int, first array<bigint>")


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the documents whose ids are in ``wanted`` (doc_id), and perhaps of others.

    Up to an eighth of its bits, the ids go to the tasks as a filter of fixed size, so texts need no
    shuffle and those that pass by accident only cost their set; more ids are joined with the texts.
    """
    table = None
    if wanted.count() <= DOCUMENT_BITS // 8:
        slot = F.xxhash64("doc_id").bitwiseAND(F.lit(DOCUMENT_BITS - 1))
        table = docs.sparkSession.sparkContext.broadcast(_bit_table(wanted.select(slot.alias("slot")), DOCUMENT_BITS))
        docs = docs.select("text", slot.alias("slot"))
    else:
        docs = docs.join(wanted.select("doc_id").hint("merge"), "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if table:
                batch = batch.filter(pa.array(_in_table(table.value, batch.column("slot").to_numpy())))
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                names = pa.array([class_of(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([names, pa.array([x.tobytes() for x in sets], pa.binary())], ["class", "shingles"])

    return docs.mapInArrow(run, "class bigint, shingles binary")


def _with_sets(pairs: DataFrame, reps: DataFrame, docs: DataFrame, words: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``pairs`` (a, b) of classes with their whole sets x and y, as bytes.

    A class may come with two rows, from documents that passed by accident: callers take distinct rows.
    """
    needed = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    needed = keep(reps.join(needed, "class").select("class", F.col("rep").alias("doc_id")))
    sets = _whole_sets(docs, needed.select("doc_id"), words)
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("shingles").alias("x")), "a")
    return both.join(sets.select(F.col("class").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")


def _read(column: pa.Array) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), np.int64) for x in column)


def _linked(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold on their whole sets (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(_read(batch.column("x")), _read(batch.column("y")), strict=True):
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                alike.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint").distinct()


def _differences(pairs: DataFrame) -> DataFrame:
    """(class, g, n, size, lost, delta) of the pairs (class a, pivot b) that are half alike or more: sizes
    of the set and its pivot, how many of the pivot's shingles it lacks, and all that only one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike, sizes, deltas = [], [], []
            for x, y in zip(_read(batch.column("x")), _read(batch.column("y")), strict=True):
                delta = np.setxor1d(x, y, assume_unique=True)
                common = (len(x) + len(y) - len(delta)) // 2
                alike.append(100 * common >= PIVOT_PERCENT * (len(x) + len(y) - common))
                if alike[-1]:
                    sizes.append((len(x), len(y), len(y) - common))
                    deltas.append(delta.tobytes())
            kept = batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))
            numbers = np.array(sizes, np.int32).reshape(-1, 3)
            columns = [*kept.columns, *(pa.array(numbers[:, k]) for k in range(3)), pa.array(deltas, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["class", "g", "n", "size", "lost", "delta"])

    return pairs.mapInArrow(run, "class bigint, g bigint, n int, size int, lost int, delta binary").dropDuplicates(["class"])


def _pivots(lists: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): for each class the most central set that its lists name and that shares most of its first
    shingles. A list names one set, the one whose own lists hold most entries; no window gathers a list."""
    lengths = keep(lists.groupBy("h").agg(F.count("*").alias("m")))
    central = keep(lists.join(lengths, "h").groupBy("class").agg(F.sum("m").alias("c")))
    named = lists.join(central, "class").groupBy("h").agg(F.max(F.struct("c", "class", "n")).alias("y"))
    rows = lists.join(keep(named), "h").filter(F.col("class") != F.col("y.class"))
    rows = rows.filter(2 * F.least("n", "y.n") >= F.greatest("n", "y.n"))
    pairs = rows.groupBy("class", F.col("y.class").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("y.n").alias("m"))
    # so many common first shingles as sets that are half alike would have, roughly
    first = F.least("n", "m") - F.ceil(percent * F.least("n", "m") / 100.0) + 1
    pairs = pairs.filter(4 * F.col("shared") >= first)
    return pairs.groupBy(F.col("class").alias("a")).agg(F.max(F.struct("shared", "b")).alias("p")).select("a", "p.b")


def _tied(percent: int) -> Column:
    """Does a member link with the pivot of its group? Pivots do with themselves."""
    return (100 + percent) * (F.col("size") - F.col("lost")).cast("long") >= percent * (F.col("n") + F.col("size")).cast("long")


def _tiles(members: DataFrame, keep: Callable[[DataFrame], DataFrame], loose: int | None = None) -> DataFrame:
    """Rows of ``members`` for each tile (g, lo, hi) that compares their block (block) with another.

    Blocks hold differences of about one size, so that whole tiles are certain without reading them. With
    ``loose``, the percentage of a link, members that link with their pivot are not compared with each
    other: they are connected as it is. So a group of near copies of its pivot costs no tile.
    """
    order = F.floor(F.log2(F.octet_length("delta") / 8 + 1)).cast("int")
    # blocks of tied members come first, with the numbers below ``tied``
    members = members.withColumn("bucket", order if loose is None else order + F.when(_tied(loose), 0).otherwise(TIED))
    filled = members.groupBy("g", "bucket").agg(F.count("*").alias("rows"), F.sum(F.octet_length("delta").cast("long")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("rows") / F.lit(BLOCK_ROWS), F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int").alias("blocks")
    # one short list a group: differences have some 40 orders of size at most
    plan = filled.select("g", "bucket", blocks, "rows").groupBy("g").agg(F.sort_array(F.collect_list(F.struct("bucket", "blocks"))).alias("plan"), F.sum("rows").alias("m"))
    plan = keep(plan.filter("m > 1").drop("m"))
    before = F.expr("aggregate(filter(plan, p -> p.bucket < bucket), 0, (n, p) -> n + p.blocks)")
    own = F.expr("filter(plan, p -> p.bucket = bucket)[0].blocks")
    count = F.expr("aggregate(plan, 0, (n, p) -> n + p.blocks)")
    placed = members.join(plan, "g").withColumn("block", before + F.pmod(F.xxhash64("class"), own).cast("int"))
    if loose is not None:
        tied = F.expr(f"aggregate(filter(plan, p -> p.bucket < {TIED}), 0, (n, p) -> n + p.blocks)")
        placed = placed.withColumns({"first": F.when(F.col("block") < tied, tied).otherwise(0), "count": count}).filter("first < count")
        placed = placed.withColumn("other", F.explode(F.sequence("first", F.col("count") - 1)))
    else:
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    return placed.select(
        "g", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class", "n", "size", "lost", "docs", "delta"
    )


def _common(deltas: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many elements the sets of rows a have in common with those of rows b."""
    rows = np.repeat(np.arange(len(deltas)), [len(x) for x in deltas])
    values = np.concatenate(deltas) if deltas else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, rows = values[order], rows[order]
    turns = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    held = np.diff(np.append(turns, len(values)))
    column = np.repeat(np.arange(len(held)), held)
    wide = held > 16
    total = np.zeros((len(a), len(b)), np.float32)
    # elements that many rows hold: products of 0/1 matrices, some columns at a time
    at = np.cumsum(wide) - 1
    for start in range(0, int(wide.sum()), 2048):
        some = wide[column] & (at[column] >= start) & (at[column] < start + 2048)
        held_by = np.zeros((len(deltas), 2048), np.float32)
        held_by[rows[some], at[column[some]] - start] = 1
        total += held_by[a] @ held_by[b].T
    # the others: pairs of their holders
    few = ~wide[column]
    rows, column = rows[few], column[few]
    pairs = []
    for k in range(1, 16):
        same = np.flatnonzero(column[k:] == column[:-k])
        if not len(same):
            break
        pairs.append(rows[same] * len(deltas) + rows[same + k])
    if pairs:
        count = np.bincount(np.concatenate(pairs), minlength=len(deltas) ** 2).reshape(len(deltas), len(deltas))
        total += (count + count.T)[np.ix_(a, b)]
    return total.astype(np.int64)


def _tile_links(rows: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows a, rows b, links between them) of one tile."""
    n, size, lost, block = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "size", "lost", "block"))
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    reach = lambda common: (100 + percent) * common >= percent * (n[a][:, None] + n[b][None, :])
    least = size[0] - lost[a][:, None] - lost[b][None, :]
    deltas = [x for c in rows.column("delta").chunks for x in _read(c)]
    d = np.array([len(x) for x in deltas])
    links = reach(least)
    if (reach(least + np.minimum(d[a][:, None], d[b][None, :])) & ~links).any():
        links = reach(least + _common(deltas, a, b))
    if lo == hi:
        np.fill_diagonal(links, False)
    return a, b, links


def _counted(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """(class, others, to) for the linked rows of one tile: documents they link with, and the least class
    that links inside the tile lead to."""
    a, b, links = _tile_links(rows, percent)
    name, weight = rows.column("class").to_numpy(), rows.column("docs").to_numpy()
    others, to = np.zeros(len(name), np.int64), name.copy()
    np.add.at(others, a, links @ weight[b])
    if rows.column("lo")[0] != rows.column("hi")[0]:
        np.add.at(others, b, links.T @ weight[a])
    top = np.iinfo(np.int64).max
    while links.any():
        before = to.copy()
        to[a] = np.minimum(to[a], np.where(links, to[b][None, :], top).min(axis=1))
        to[b] = np.minimum(to[b], np.where(links, to[a][:, None], top).min(axis=0))
        if (to == before).all():
            break
    some = others > 0
    return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (name, others, to)], ["class", "others", "to"])


def _listed(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """(a, b) for the links of one tile, the larger class first."""
    a, b, links = _tile_links(rows, percent)
    i, j = np.nonzero(links)
    x, y = rows.column("class").to_numpy()[a[i]], rows.column("class").to_numpy()[b[j]]
    if rows.column("lo")[0] == rows.column("hi")[0]:
        x, y = x[x > y], y[x > y]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])


def _by_tile(tiles: DataFrame, made: Callable[[pa.Table, int], pa.RecordBatch], percent: int, schema: str) -> DataFrame:
    """``made`` for each tile. Tiles follow each other in sorted partitions, so one at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("g", "lo", "hi")], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                now = tuple(keys[start].tolist())
                if held and now != key:
                    yield made(pa.Table.from_batches(held), percent)
                    held = []
                key = now
                held.append(batch.slice(start, end - start))
        if held:
            yield made(pa.Table.from_batches(held), percent)

    return tiles.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi").mapInArrow(run, schema)


def _across(lists: DataFrame, members: DataFrame, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of classes with different pivots, a > b, that may reach the threshold."""
    lists = lists.join(members.select("class", "g"), "class", "left").withColumn("g", F.coalesce("g", "class"))
    lists = keep(lists)
    mixed = keep(lists.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("h"))
    own = Window.partitionBy("class")  # a class has no more entries than first shingles
    lists = lists.join(mixed, "h").withColumns({"rank": F.row_number().over(own.orderBy("pos")) - 1, "entries": F.count("*").over(own)})
    step = math.log(100.0 / percent) / STEPS
    block = lambda n: F.floor(F.log(n) / F.lit(step) + F.lit(1e-9)).cast("int")
    lists = keep(lists.withColumn("block", block(F.col("n"))))
    # the largest partner whose threshold what stands behind this position can reach
    most = F.least((F.col("n") - F.col("pos")) * (100.0 + percent) / percent - F.col("n"), F.col("n") * 100.0 / percent)
    smaller = lists.filter(most + 1e-6 >= F.col("n")).withColumn("meets", F.explode(F.sequence("block", F.greatest(block(most + 1e-6), F.col("block")))))
    x, y = lists.alias("x"), smaller.alias("y")
    n_x, n_y, p_x, p_y, r_x, r_y, s_x, s_y = (F.col(f"{side}.{c}") for c in ("n", "pos", "rank", "entries") for side in ("x", "y"))
    beyond = lambda n: F.ceil(F.lit(percent) * n / 100.0 - F.lit(1e-9)) - 1  # noqa: E731  members after the first ones
    need = _need(n_x, n_y, percent)
    # before this entry only entries of mixed lists count; from here on, of two sets the one whose first
    # shingles end earlier in the order has all else that is common beyond them
    left = F.least(r_x, r_y) + F.least(F.greatest(s_x - r_x + beyond(n_x), s_y - r_y + beyond(n_y)), n_x - p_x, n_y - p_y)
    fits = (100 * n_y >= percent * n_x) & (n_x - p_x >= need) & (n_y - p_y >= need) & (left >= need)
    once = (n_x > n_y) | ((n_x == n_y) & (F.col("x.class") > F.col("y.class")))
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.block") == F.col("y.meets")) & once & (F.col("x.g") != F.col("y.g")) & fits)
    pairs = pairs.groupBy(F.col("x.class").alias("x"), F.col("y.class").alias("y")).agg(
        F.count("*").alias("shared"), F.first(n_x).alias("n_x"), F.first(n_y).alias("n_y"), F.max(p_x).alias("p_x"), F.max(p_y).alias("p_y")
    )
    # the entries met are the first common shingles; more can only stand behind the last of them
    behind = F.least(F.col("n_x") - F.col("p_x"), F.col("n_y") - F.col("p_y")) - 1
    pairs = pairs.filter(F.col("shared") + behind >= _need(F.col("n_x"), F.col("n_y"), percent))
    return pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _join(
    docs: DataFrame, words: int, percent: int, keep: Callable[[DataFrame], DataFrame], loose: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, n, class), (classes: class, rep, docs), tiles, and links (a, b) outside the tiles, which with
    ``loose`` are those that connect and not all."""
    sets = keep(_sets(docs, words, percent, _frequent(docs, words, keep)))
    reps = keep(sets.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs")))
    # index lists: one row for each first shingle of a class, with its position. A frequent shingle is in
    # other sets for certain; of the rest, lists of one entry go (each looks only at its neighbours)
    entry = sets.select("class", "n", "rare", F.posexplode("first").alias("pos", "h"))
    often = entry.filter("pos >= rare").select("h", "class", "n", "pos").dropDuplicates(["h", "class"])
    in_list = Window.partitionBy("h").orderBy("class")
    rare = entry.filter("pos < rare").select("h", "class", "n", "pos", F.lag("class").over(in_list).alias("last"), F.lead("class").over(in_list).alias("next"))
    rare = rare.filter("(last IS NOT NULL OR next IS NOT NULL) AND NOT (last <=> class)").drop("last", "next")
    lists = keep(rare.unionByName(often))
    members = _differences(_with_sets(keep(_pivots(lists, percent, keep)), reps, docs, words, keep))
    members = keep(members.join(reps.select("class", "docs"), "class"))
    # pivots that have no pivot themselves stand in their own group, with no difference
    sizes = members.groupBy(F.col("g").alias("class")).agg(F.first("size").alias("n"))
    roots = sizes.join(members.select("class"), "class", "left_anti").join(reps.select("class", "docs"), "class")
    roots = roots.select("class", F.col("class").alias("g"), "n", F.col("n").alias("size"), F.lit(0).alias("lost"), F.expr("X''").alias("delta"), "docs")
    members = keep(members.unionByName(roots))
    pairs = keep(_across(lists, members, percent, keep))
    across = keep(_linked(_with_sets(pairs, reps, docs, words, keep), percent))
    if loose:
        ties = members.filter(_tied(percent) & (F.col("class") != F.col("g")))
        across = across.unionByName(ties.select(F.greatest("class", "g").alias("a"), F.least("class", "g").alias("b")))
    return sets.select("doc_id", "n", "class"), reps, _tiles(members, keep, percent if loose else None), across


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every document of ``docs`` (doc_id, text).

    Without ``count_links`` n_links is null: links that connect nothing new are then not looked for.

    Two documents link when 100 * intersection >= percent * union of their sets; n_links counts the other
    documents that one links with, component_id is the smallest doc_id reachable by links. A null text,
    or one without words, has an empty set and links with nothing; very long texts are hashed whole.
    Equal sets need no pairs: they are one class, and their documents link with each other. Rows that
    repeat a doc_id are treated as separate documents of the same id. An empty table gives an empty
    result; columns other than doc_id and text are not read. Shingles are told apart by 64-bit hashes,
    classes by a 64-bit hash of their set and its size.
    """
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        rows, reps, tiles, across = _join(docs, words, percent, keep, not count_links)
        counted = keep(_by_tile(tiles, _counted, percent, "class bigint, others bigint, to bigint"))
        edges = counted.select(F.col("class").alias("src"), F.col("to").alias("dst"))
        groups = keep(connected_components(edges.unionByName(across.select(F.col("a").alias("src"), F.col("b").alias("dst")))))
        named = reps.join(groups, F.col("class") == F.col("node"), "left").select("class", "rep", "docs", F.coalesce("component", "class").alias("g"))
        named = keep(named)
        smallest = keep(named.groupBy("g").agg(F.min("rep").alias("component_id")))
        named, counts = named.join(smallest, "g"), F.lit(None).cast("long")
        if count_links:
            both = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b")))
            others = both.join(reps.select(F.col("class").alias("b"), F.col("docs").alias("others")), "b").select(F.col("a").alias("class"), "others")
            others = others.unionByName(counted.select("class", "others")).groupBy("class").agg(F.sum("others").alias("others"))
            named = named.join(others, "class", "left")
            counts = F.col("docs") - 1 + F.coalesce("others", F.lit(0))
        named = materialise(named.select("class", "component_id", counts.alias("n_links")))
        rows = materialise(rows)
    linked = rows.join(named, "class").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_links")
    empty = rows.filter("class IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty.withColumn("n_links", F.lit(0 if count_links else None).cast("long")))


def links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, linked_id): every link between different texts, once, with the smaller id first; each
    class of equal sets stands by its smallest doc_id. The pairs of a group of m near copies grow with
    m * m: this lists them because it is asked to. Special cases are those of :func:`similar_documents`.
    """
    docs = docs.select("doc_id", "text")
    with scratch(docs.sparkSession) as keep:
        _, reps, tiles, across = _join(docs, words, percent, keep)
        found = _by_tile(tiles, _listed, percent, "a bigint, b bigint").unionByName(across)
        named = found.join(reps.select(F.col("class").alias("a"), F.col("rep").alias("x")), "a")
        named = named.join(reps.select(F.col("class").alias("b"), F.col("rep").alias("y")), "b")
        return materialise(named.select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("linked_id")))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component: one with the smallest doc_id.

    Rows that repeat a doc_id are documents of their own: of those that link one stays, unlinked ones all
    stay. Rows with a null doc_id stay as they are and link with nothing.
    """
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    keyed = rows.filter("doc_id IS NOT NULL").select(F.struct("doc_id", "_row").alias("doc_id"), "text")
    firsts = similar_documents(keyed, words, percent, count_links=False).filter("doc_id = component_id").select("doc_id._row")
    firsts = firsts.unionByName(rows.filter("doc_id IS NULL").select("_row"))
    # the ids grow with the documents: a merge join at every size
    return rows.join(firsts.hint("merge"), "_row", "left_semi").select(*docs.columns)
