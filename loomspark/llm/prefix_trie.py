"""Operator 12: the prefix trie of conversations, measured by the Euler-tour technique.

Conversations that begin with the same turns share nodes, so a model's work on a shared prefix is done once.
A node is named by its smallest member and its depth. Each node gives an enter and an exit arc; every arc
knows the next one from local facts only (first child, next sibling, parent), so the tour is a linked list.
The list is ranked distributedly, and sums over the positions then give what lies below a node: the sum at its
exit less the sum at its enter. No step walks a path or gathers the children of a node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import WORD, materialise, scratch

#: Rows of one group that one task sorts; larger groups are range-sorted over many.
LARGE = 50_000
#: Turns, arcs or ids summed within one task before sums of sums shift them.
SPAN = 4096
#: Arcs beyond which a list is contracted before its rest is ranked by doubling.
DOUBLED = 4_000_000
LANES = ["l0", "l1", "l2", "l3"]
Keep = Callable[[DataFrame], DataFrame]


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, keep: Keep) -> DataFrame:
    """Add ``name``: 1, 2, ... within each group by ``order``, which must decide all rows. ``rows`` is a written table.

    Groups of more than LARGE rows are range-sorted as a whole: a row's number is its place in its
    partition plus the rows of its group in earlier partitions.
    """
    large = keep(rows.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > LARGE).drop("_n"))
    plain = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    if large.isEmpty():
        return rows.withColumn(name, plain)
    small = rows.join(large, group, "left_anti").withColumn(name, plain)
    ranged = rows.join(large, group, "left_semi").repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ranged = keep(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    counts = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    placed = ranged.join(counts, [*group, "_part"])
    placed = placed.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return small.unionByName(placed.select(*small.columns))


def rebuilt_turns(turns: DataFrame, keep: Keep, shared_heads: bool = True) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words, last) of every turn of every rebuilt conversation, and (conv_id, length).

    ``turns`` has conv_id, turn, role, text. Turns stand in order of turn (null first), then of the digest
    of role and text. With ``shared_heads`` a conversation begins with the first h turns of the
    conversation numbered conv_id - conv_id % 20 and goes on after its own first h, h = crc32(conv_id) % 4.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("_row"),
    )
    rows = keep(rows)  # texts go no further: digests and word counts stand for them
    own = numbered(rows, ["conv_id"], ["turn", "digest", "_row"], "place", keep).select("conv_id", "place", "digest", "words")
    if not shared_heads:
        lengths = own.groupBy("conv_id").agg(F.count("*").alias("length"))
        own = own.withColumnRenamed("place", "depth")
    else:
        own = keep(own)
        convs = own.groupBy("conv_id").agg(F.count("*").alias("_own"))
        convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % 4, "base": F.col("conv_id") - F.col("conv_id") % 20})
        # at most three rows of each twentieth conversation, and each goes to twenty conversations at most
        heads = own.filter((F.col("place") <= 3) & (F.col("conv_id") % 20 == 0))
        taken = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("_heads"))
        convs = convs.join(taken, "base", "left").withColumn("_taken", F.least("h", F.coalesce("_heads", F.lit(0))))
        convs = convs.withColumn("length", F.col("_taken") + F.greatest(F.col("_own") - F.col("h"), F.lit(0)))
        convs = keep(convs.select("conv_id", "base", "h", "_taken", "length"))
        first = heads.withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("place <= h")
        first = first.select("conv_id", F.col("place").alias("depth"), "digest", "words")
        rest = own.join(convs.select("conv_id", "h", "_taken"), "conv_id").filter("place > h")
        rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("_taken")).alias("depth"), "digest", "words")
        own, lengths = first.unionByName(rest), convs.select("conv_id", "length")
    return own, lengths


def prefixes(turns: DataFrame, keep: Keep) -> DataFrame:
    """Add the lanes l0 to l3 of the prefix that ends with each turn, and p0 to p3 of the one before it.

    A lane is a sum of 32 bits of a hash of (depth, digest) over the turns of the prefix. Sums need no walk
    along a conversation: they are taken in spans and shifted by the sums of earlier spans. Four lanes hold
    128 bits, by which prefixes are told apart.
    """
    one, two = F.xxhash64("depth", "digest"), F.xxhash64("digest", F.lit(77), "depth")
    mask = F.lit(0xFFFFFFFF)
    parts = [F.shiftrightunsigned(one, 32), one.bitwiseAND(mask), F.shiftrightunsigned(two, 32), two.bitwiseAND(mask)]
    rows = turns.withColumns({f"h{i}": p for i, p in enumerate(parts)} | {"_span": F.floor((F.col("depth") - 1) / SPAN)})
    inside = Window.partitionBy("conv_id", "_span").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = keep(rows.withColumns({c: F.sum(f"h{i}").over(inside) for i, c in enumerate(LANES)}))
    # a full span's last row has the sum of the span: few rows, none for conversations within one span
    full = rows.filter(F.col("depth") % SPAN == 0).select("conv_id", (F.col("_span") + 1).alias("_span"), *LANES)
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, 0)
    shift = full.select("conv_id", "_span", *(F.sum(c).over(before).alias(f"s{i}") for i, c in enumerate(LANES)))
    rows = rows.join(shift, ["conv_id", "_span"], "left")
    rows = rows.withColumns({c: F.col(c) + F.coalesce(f"s{i}", F.lit(0)) for i, c in enumerate(LANES)})
    return rows.withColumns({f"p{i}": F.col(c) - F.col(f"h{i}") for i, c in enumerate(LANES)}).select(
        "conv_id", "depth", "words", *LANES, *(f"p{i}" for i in range(4))
    )


def joined_hash(rows: DataFrame, keys: list[str], keep: Keep) -> DataFrame:
    """SHA-256 of the decimal conv_ids of each key in ascending order, joined by commas: (keys, ends_sha256).

    Ids of one range of 2^12 are sorted and joined in one row; a key with one such row is hashed in the JVM.
    For others a task takes the rows of a key in order and feeds them to one running hash, so memory holds
    one row, whatever the size of the key.
    """
    ids = rows.withColumn("_range", F.shiftright("conv_id", 12)).groupBy(*keys, "_range").agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    parts = keep(ids.withColumn("_ids", F.array_join(F.col("_ids").cast("array<string>"), ",")))
    many = parts.groupBy(*keys).agg(F.count("*").alias("_n"), F.first("_ids").alias("_ids"))
    single = many.filter("_n = 1").select(*keys, F.sha2("_ids", 256).alias("ends_sha256"))
    rest = parts.join(many.filter("_n > 1").select(*keys), keys)
    rest = rest.repartition(*keys).sortWithinPartitions(*keys, "_range").select(*keys, "_ids")
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in at), pa.array([state.hexdigest()])], [*keys, "ends_sha256"])

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:width] == at:
                    state.update(b",")
                else:
                    if at is not None:
                        yield out()
                    at, state = row[:width], hashlib.sha256()
                state.update(row[width].encode())
        if at is not None:
            yield out()

    hashed = rest.mapInArrow(run, ", ".join([f"{k} long" for k in keys] + ["ends_sha256 string"]))
    return single.unionByName(hashed)


def doubled(arcs: DataFrame, keep: Keep) -> DataFrame:
    """(arc, rank): ``dist`` summed from each arc to the end of its list, by pointer doubling.

    ``arcs`` has arc, next (null at the end) and dist. Arcs that have reached the end take no part in the
    joins, and of the others no two share a next, so no key is ever hot.
    """
    current = keep(arcs)
    while True:
        live = current.filter("next IS NOT NULL")
        if live.isEmpty():
            return current.select("arc", F.col("dist").alias("rank"))
        jump = current.select(F.col("arc").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"))
        moved = live.join(jump, "next").select("arc", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"))
        current = keep(current.filter("next IS NULL").unionByName(moved))


def list_ranks(arcs: DataFrame, keep: Keep, doubled_up_to: int = DOUBLED) -> DataFrame:
    """(arc, rank) of linked lists ``arcs`` (arc, next): how many arcs stand from each one to its list's end.

    A long list is contracted first. By a coin for each arc and round, an arc that shows tails behind one
    that shows heads leaves the list, its distance going to the arc before it; about a quarter leaves in a
    round. What is left is ranked by doubling, and the arcs that left come back in reverse: the rank of an
    arc is that of the one before it less the distance between them.
    """
    current, gone, turn = keep(arcs.select("arc", "next", F.lit(1).cast("long").alias("dist"))), [], 0
    while current.count() > doubled_up_to:
        heads = lambda c, t=turn: F.pmod(F.xxhash64(F.lit(t), c), F.lit(2)) == 0
        pairs = current.filter(F.col("next").isNotNull() & heads("arc") & ~heads("next"))
        pairs = pairs.select(F.col("next").alias("arc"), F.col("arc").alias("before"), F.col("dist").alias("gap"))
        marked = keep(current.join(pairs, "arc", "left"))
        left = marked.filter("before IS NOT NULL")
        gone.append(left.select("arc", "before", "gap"))
        moved = left.select(F.col("before").alias("arc"), F.col("next").alias("_next"), F.col("dist").alias("_dist"), F.lit(True).alias("_moved"))
        rest = marked.filter("before IS NULL").select("arc", "next", "dist").join(moved, "arc", "left")
        current = keep(
            rest.select("arc", F.when(F.col("_moved"), F.col("_next")).otherwise(F.col("next")).alias("next"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"))
        )
        turn += 1
    ranks = doubled(current, keep)
    for left in reversed(gone):
        back = left.join(ranks.select(F.col("arc").alias("before"), "rank"), "before").select("arc", (F.col("rank") - F.col("gap")).alias("rank"))
        ranks = keep(ranks.unionByName(back))
    return ranks


def summed_before(rows: DataFrame, place: str, values: list[str], keep: Keep) -> DataFrame:
    """Add for each value ``_before_<value>``, its sum over the rows with a smaller ``place`` (dense from 0)."""
    rows = rows.withColumn("_span", F.floor(F.col(place) / SPAN))
    inside = Window.partitionBy("_span").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    # one row for SPAN rows, of two longs: what one task orders is that much smaller than the list
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_span").agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    sums = keep(sums.select("_span", *(F.coalesce(F.sum(f"_sum_{v}").over(before), F.lit(0)).alias(f"_shift_{v}") for v in values)))
    rows = rows.withColumns({f"_in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(sums, "_span")
    rows = rows.withColumns({f"_before_{v}": F.col(f"_in_{v}") + F.col(f"_shift_{v}") for v in values})
    return rows.drop("_span", *(f"_in_{v}" for v in values), *(f"_shift_{v}" for v in values))


def euler_arcs(nodes: DataFrame) -> DataFrame:
    """The arcs of the tour over ``nodes`` (conv_id, depth, parent_conv_id, first_child, sibling): arc, next, conv_id, depth, enters.

    An arc is a struct (conv_id, step) with step 2 * depth to enter and 2 * depth + 1 to leave.
    """

    def arc(conv: Column | str, step: Column) -> Column:
        return F.struct(F.col(conv).alias("c") if isinstance(conv, str) else conv.alias("c"), step.cast("long").alias("s"))

    down, d = F.col("first_child").isNotNull(), F.col("depth")
    enter = F.struct(
        arc("conv_id", 2 * d).alias("arc"), F.when(down, arc("first_child", 2 * d + 2)).otherwise(arc("conv_id", 2 * d + 1)).alias("next"), F.lit(True).alias("enters")
    )
    up = F.when(F.col("sibling").isNotNull(), arc("sibling", 2 * d)).when(d > 0, arc("parent_conv_id", 2 * d - 1))
    leave = F.struct(arc("conv_id", 2 * d + 1).alias("arc"), up.alias("next"), F.lit(False).alias("enters"))
    return nodes.select("conv_id", "depth", "leaf", "saves", F.explode(F.array(enter, leave)).alias("_a")).select("conv_id", "depth", "leaf", "saves", "_a.*")


def prefix_trie(turns: DataFrame, shared_heads: bool = True, doubled_up_to: int = DOUBLED) -> DataFrame:
    """The trie of the conversations in ``turns`` (conv_id, turn, role, text; others are not read): a row a node.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without a conv_id belong to no conversation; null roles and texts are empty; rows that
    repeat are turns each; turns of one number stand in order of the digest of role and text. Without
    conversations there is no node, not even the root. One table, the result, stays in the shared folder.
    """
    spark = turns.sparkSession
    with scratch(spark) as keep:
        own, lengths = rebuilt_turns(turns, keep, shared_heads)
        lengths = keep(lengths)
        rows = keep(prefixes(own, keep).join(lengths, "conv_id").withColumn("last", F.col("depth") == F.col("length")).drop("length"))
        nodes = rows.groupBy("depth", *LANES).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), *(F.max(f"p{i}").alias(f"p{i}") for i in range(4)),
            F.max("last").alias("ends"),
        )
        zero = [F.lit(0).cast("long").alias(c) for c in LANES]
        root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max(F.col("length") == 0).alias("ends")).filter("n_convs > 0")
        root = root.select(
            F.lit(0).cast("long").alias("depth"), *zero, "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), *(F.lit(None).cast("long").alias(f"p{i}") for i in range(4)), "ends"
        )
        nodes = keep(nodes.unionByName(root))
        # of a parent: how many children, and the smallest
        below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"p{i}").alias(f"l{i}") for i in range(4)))
        below = below.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
        named = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(c).alias(f"p{i}") for i, c in enumerate(LANES)), F.col("conv_id").alias("parent_conv_id"))
        nodes = nodes.join(below, ["depth", *LANES], "left").join(named, ["depth", "p0", "p1", "p2", "p3"], "left")
        nodes = keep(
            nodes.select(
                "conv_id", "depth", *LANES, "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "first_child",
                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saves"), "ends",
            )
        )
        # siblings are numbered by their names; the next one is found by its number
        children = keep(nodes.filter("depth > 0").select("parent_conv_id", "depth", "conv_id"))
        children = keep(numbered(children, ["parent_conv_id", "depth"], ["conv_id"], "place", keep))
        after = children.select("parent_conv_id", "depth", (F.col("place") - 1).alias("place"), F.col("conv_id").alias("sibling"))
        siblings = children.join(after, ["parent_conv_id", "depth", "place"]).select("conv_id", "depth", "sibling")
        linked = keep(nodes.join(siblings, ["conv_id", "depth"], "left"))
        tour = keep(euler_arcs(linked))
        ranks = list_ranks(tour, keep, doubled_up_to)
        total = tour.count()
        placed = tour.join(ranks, "arc").select(
            "conv_id", "depth", "enters", (F.lit(total) - F.col("rank")).alias("position"),
            *(F.when(F.col("enters"), F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saves")),
        )
        placed = summed_before(keep(placed), "position", ["leaf", "saves"], keep)
        # what a node holds: the sum at its exit less the sum at its enter
        sign = F.when(F.col("enters"), -1).otherwise(1)
        inside = placed.groupBy("conv_id", "depth").agg(
            F.sum(sign * F.col("_before_leaf")).alias("n_leaves"), F.sum(sign * F.col("_before_saves")).alias("saved_tokens"), F.min("position").alias("position")
        )
        ends = rows.filter("last").select("conv_id", "depth", *LANES)
        ends = ends.unionByName(lengths.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("depth"), *zero))
        hashes = joined_hash(ends, ["depth", *LANES], keep)
        out = nodes.join(inside, ["conv_id", "depth"]).join(hashes, ["depth", *LANES], "left")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        return materialise(
            out.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "position"
            )
        )


#: CRC-32 of a decimal number in DuckDB, which has no such function: one bit a step.
CRC32_SQL = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({}::VARCHAR, ''),
  lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, e: xor(xor(s, e) >> 1, CASE WHEN xor(s, e) % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)), 4294967295::UBIGINT)"""
#: The query's rows: prefixes as whole texts, and a node's subtree from the ancestors of every other node.
ORACLE_SQL = rf"""
WITH t AS (SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t),
h AS (SELECT DISTINCT conv_id, ({CRC32_SQL.format('conv_id')} % 4)::BIGINT AS h FROM o),
r AS (SELECT h.conv_id, b.place AS depth, b.digest, b.words FROM h JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20 AND b.place <= h
  UNION ALL SELECT h.conv_id, o.place - h + least(h, (SELECT count(*) FROM o b WHERE b.conv_id = h.conv_id - h.conv_id % 20)), o.digest, o.words FROM h JOIN o ON o.conv_id = h.conv_id AND o.place > h),
p AS (SELECT *, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM r
  UNION ALL SELECT conv_id, 0, '', 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM h),
n AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM p GROUP BY prefix, depth),
c AS (SELECT n.*, q.conv_id AS parent_conv_id, (SELECT count(*) FROM n k WHERE k.depth = n.depth + 1 AND k.prefix[1:64 * n.depth] = n.prefix) AS n_children
  FROM n LEFT JOIN n q ON q.depth = n.depth - 1 AND q.prefix = n.prefix[1:64 * (n.depth - 1)]),
s AS (SELECT p.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens
  FROM c b JOIN p ON p.conv_id = b.conv_id AND p.depth <= b.depth GROUP BY p.prefix)
SELECT c.conv_id, c.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM c JOIN s USING (prefix)"""
