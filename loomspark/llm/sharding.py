"""Operator 4: sharding by a k-d tree over metadata, with leaves of near equal bytes.

A node that owns several shards is split along its widest dimension at the weighted median of bytes
(or at the fraction that its two halves' shard counts ask for). The median is found by refining a
histogram of sums, fifteen bits of the sort key at a time, so no node's rows are sorted or gathered;
ties in the dimension go on by a hash of the row. What the driver holds is one row for each node.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.prefix_trie import numbered
from loomspark.llm.shared import buckets_for, materialise, release, running_sum, scratch

ROUND_BITS, ROUNDS = 15, 4
COORDINATE_BITS = 30
#: A table of one row a node is broadcast up to so many nodes (some 40 bytes each), joined beyond.
BROADCAST_NODES = 50_000


def document_dimensions(text_bytes: Column) -> dict[str, Column]:
    """Coordinates in 0..1 of ``documents``: size on a logarithmic scale, source and language by hash."""
    return {
        "size": F.least(F.log2(text_bytes + F.lit(1.0)) / F.lit(40.0), F.lit(1.0)),
        "source": F.crc32(F.coalesce(F.col("source"), F.lit(""))) / F.lit(float(1 << 32)),
        "lang": F.crc32(F.coalesce(F.col("lang"), F.lit(""))) / F.lit(float(1 << 32)),
    }


def _small(spark, rows: list[tuple], schema: dict[str, str]) -> DataFrame:
    """A table of one row a node, as SQL literals; a Python list would start Python workers to be read."""
    values = ", ".join(f"({', '.join(f'CAST({v!r} AS {kind})' for v, kind in zip(row, schema.values(), strict=True))})" for row in rows)
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(schema)})")
    return F.broadcast(df) if len(rows) <= BROADCAST_NODES else df


def _split_points(base: DataFrame, nodes: dict[int, int], dims: list[str]) -> dict[int, int]:
    """For each node that owns several shards, the first sort key of its right half, and its dimension.

    Returns {node: (dimension index, key)}.
    """
    spark = base.sparkSession
    busy = [n for n, k in nodes.items() if k > 1]
    rows = base.join(_small(spark, [(n,) for n in busy], {"node": "int"}), "node")
    spread = rows.groupBy("node").agg(
        F.sum("size").alias("total"), *[(F.max(d) - F.min(d)).alias(f"w_{d}") for d in dims]
    ).collect()
    state = {}
    for r in spread:
        widths = [r[f"w_{d}"] for d in dims]
        k = nodes[r.node]
        state[r.node] = [widths.index(max(widths)), 0, r.total * (k // 2) / k]  # dimension, prefix, bytes still to go left
    result = {}
    for turn in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - 1 - turn)
        open_ = [(n, d, prefix, goal) for n, (d, prefix, goal) in state.items() if n not in result]
        if not open_:
            break
        now = rows.join(_small(spark, open_, {"node": "int", "dim": "int", "prefix": "bigint", "goal": "double"}), "node")
        now = now.withColumn("key", _key(dims))
        if turn:
            now = now.filter(F.shiftright("key", shift + ROUND_BITS) == F.col("prefix"))
        sums = now.groupBy("node", F.shiftright("key", shift).alias("bucket")).agg(
            F.sum("size").alias("bytes"), F.count("*").alias("n"), F.first("goal").alias("goal")
        )
        upto = Window.partitionBy("node").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("bytes").over(upto))
        crossing = sums.filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("bytes") < F.col("goal")))
        for r in crossing.collect():
            left = state[r.node][2] - (r.upto - r.bytes)  # of this bucket's bytes, so many belong left
            if r.n == 1 or turn == ROUNDS - 1:
                result[r.node] = (state[r.node][0], (r.bucket + (2 * left >= r.bytes)) << shift)
            else:
                state[r.node][1:] = [r.bucket, left]
    for n, (d, _, _) in state.items():
        result.setdefault(n, (d, 0))
    return result


def _key(dims: list[str]) -> Column:
    """Sort key of a row in its node's dimension: coordinate, then the row's hash."""
    q = F.array(*dims)[F.col("dim")]
    return F.shiftleft(q, ROUND_BITS * ROUNDS - COORDINATE_BITS).bitwiseOR(F.col("tie"))


def kd_shards(
    docs: DataFrame, size: Column, dimensions: dict[str, Column], shards: int | None = None, target_bytes: int | None = None
) -> DataFrame:
    """Add size (long), shard (int) and slot (long, gapless from 0 in each shard) to ``docs`` without ``text``.

    Give the number of shards, or the bytes a leaf may hold. Texts are not carried through the splits and
    not returned. Rows are placed one by one: rows of equal text and metadata are neighbours at every
    split and are parted only where a median falls among them, while equal texts with other metadata may
    go to other shards. Ties in a dimension go on by hashes of the text, the doc_id and a number among rows that
    are equal in both and in metadata, so the result does not depend on files or partitions. A text of any
    length is read for its size and hash only; a very long one may exceed a shard's share alone. Null metadata counts as an empty string. An empty table
    stays empty; with fewer rows than shards some shards are empty. Repeated rows are separate rows.
    Columns of the names added are replaced.
    """
    docs = docs.drop("size", "shard", "slot").withColumn("_row", F.monotonically_increasing_id())
    docs = docs.withColumn("size", size.cast("long"))
    limit = float(1 << COORDINATE_BITS)
    coordinates = {f"q_{k}": F.floor(F.least(F.greatest(c, F.lit(0.0)) * limit, F.lit(limit - 1))).cast("long") for k, c in dimensions.items()}
    tie_bits = ROUND_BITS * ROUNDS - COORDINATE_BITS
    half = (1 << (tie_bits // 2)) - 1
    rest = [c for c in docs.columns if c not in ("size", "_row")]
    content = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    docs = materialise(docs.withColumns({**coordinates, "_content": content}).drop("text"))
    dims = list(coordinates)
    # rows with equal id, text and metadata are told apart by a number among them, so files and partitions decide nothing
    alike = ["_content", "doc_id", *dims]
    with scratch(docs.sparkSession) as keep:
        rows = keep(docs.select("_row", "size", *alike))
        rows = numbered(rows, alike, ["_row"], "_copy", keep)
        turn = F.xxhash64("doc_id", "_content", "_copy")
        tie = F.shiftleft(F.col("_content").bitwiseAND(F.lit(half)), tie_bits // 2).bitwiseOR(turn.bitwiseAND(F.lit(half)))
        base = first = materialise(rows.select("_row", "size", tie.alias("tie"), turn.alias("turn"), *dims, F.lit(0).alias("node")))
    total = docs.agg(F.sum("size"), F.count("*")).first()
    if shards is None:
        shards = max(1, -(-(total[0] or 0) // target_bytes))
    nodes, spark, written = {0: shards}, docs.sparkSession, None
    while any(k > 1 for k in nodes.values()) and total[1]:
        points = _split_points(base, nodes, dims)
        table = _small(spark, [(n, d, key, n + nodes[n] // 2) for n, (d, key) in points.items()], {"node": "int", "dim": "int", "at": "bigint", "right_node": "int"})
        moved = base.join(table, "node", "left")
        moved = moved.withColumn("node", F.when(_key(dims) >= F.col("at"), F.col("right_node")).otherwise(F.col("node")))
        after = materialise(moved.select("_row", "size", "tie", "turn", *dims, "node"))
        release(written if written is not None else first)
        base = written = after
        nodes = {m: k for n, whole in nodes.items() for m, k in (((n, whole),) if whole == 1 else ((n, whole // 2), (n + whole // 2, whole - whole // 2)))}
    # slots go by a hash of the row, so that copies of one text are spread over the buckets
    placed = base.select("_row", "turn", F.col("node").alias("shard"))
    n = buckets_for(total[1])
    bucket = F.floor(F.shiftrightunsigned("turn", 34) * n / (1 << 30)).cast("int")
    # as unsigned numbers, so that buckets and rows have one order
    order = [F.shiftrightunsigned("turn", 1), F.col("turn"), "_row"]
    placed = running_sum(placed, "shard", order, bucket, F.lit(1).cast("long"), "slot").drop("turn")
    out = materialise(docs.select("_row", *[c for c in rest if c != "text"], "size").join(placed, "_row").drop("_row"))
    release(docs)
    release(base)
    return out
