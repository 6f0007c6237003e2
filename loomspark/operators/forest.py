"""Forests given as parent pointers: roots, depths, broken chains and cycles, and paths up, by pointer doubling.

After k rounds a node points 2 ** k steps up, so rounds grow with the logarithm of the longest chain and no step
walks one. Groups (traces, conversations) need no task of their own: a node is named by group and id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.lineage import written


def _pointers(nodes: DataFrame, group: str, id: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """(g, n, up, orphan): up is the parent if it is there, orphan tells that it is named but missing; and the ids."""
    rows = nodes.groupBy(F.col(group).alias("g"), F.col(id).alias("n")).agg(F.min(parent).alias("p")).filter("n IS NOT NULL")
    there = rows.select("g", F.col("n").alias("p"), F.lit(True).alias("_there"))
    named = rows.filter("p IS NOT NULL").join(there, ["g", "p"], "left")
    up = named.select("g", "n", F.when(F.col("_there"), F.col("p")).alias("up"), F.col("_there").isNull().alias("orphan"))
    return written(rows.filter("p IS NULL").select("g", "n", F.col("p").alias("up"), F.lit(False).alias("orphan")).unionByName(up), "forest"), rows


def ranked(nodes: DataFrame, group: str, id: str, parent: str) -> DataFrame:
    """(group, id, root, depth, orphan, cyclic) of each node (group, id, parent).

    The root of an orphan, whose parent is not in the table, is the orphan itself. Nodes on a cycle, or
    below one, are cyclic and have no root and no depth. Of rows that repeat an id the smallest parent
    counts; rows with a null id are no nodes; a null group holds nothing together.
    """
    base, _ = _pointers(nodes, group, id, parent)
    steps = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    current = written(base.select("g", "n", "up", F.coalesce("up", "n").alias("root"), steps.alias("depth")), "forest")
    rounds = max(1, (current.count() + 1).bit_length())
    for _ in range(rounds):  # a chain has fewer steps than there are nodes; what goes on after that goes in circles
        live = current.filter("up IS NOT NULL")
        if live.isEmpty():
            break
        above = current.select("g", F.col("n").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        moved = live.join(above, ["g", "up"]).select("g", "n", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"))
        current = written(current.filter("up IS NULL").unionByName(moved), "forest")
    around = F.col("up").isNotNull()
    out = current.select("g", "n", F.when(~around, F.col("root")).alias("root"), F.when(~around, F.col("depth")).alias("depth"), around.alias("cyclic"))
    out = out.join(base.select("g", "n", "orphan"), ["g", "n"])
    return out.select(F.col("g").alias(group), F.col("n").alias(id), "root", "depth", "orphan", "cyclic")


def paths(nodes: DataFrame, heads: DataFrame, group: str, id: str, parent: str) -> DataFrame:
    """(group, id, position): the nodes from the root, at 0, down to the head (group, id) of each group.

    A round adds to the nodes found those 2 ** k steps above them and doubles the steps. A head that is no
    node gives no path; a cycle is walked once, its positions counted back from the head, which comes last.
    """
    base, _ = _pointers(nodes, group, id, parent)
    jump = base.select("g", "n", "up")
    start = heads.select(F.col(group).alias("g"), F.col(id).alias("n")).distinct().join(base.select("g", "n"), ["g", "n"], "left_semi")
    found, step = written(start.withColumn("back", F.lit(0).cast("long")), "path"), 1
    while True:
        higher = found.join(jump.filter("up IS NOT NULL"), ["g", "n"]).select("g", F.col("up").alias("n"), (F.col("back") + step).alias("back"))
        after = written(found.unionByName(higher).groupBy("g", "n").agg(F.min("back").alias("back")), "path")
        if after.count() == found.count():
            break
        above = jump.select("g", F.col("n").alias("up"), F.col("up").alias("_up"))
        jump = written(jump.filter("up IS NOT NULL").join(above, ["g", "up"]).select("g", "n", F.col("_up").alias("up")), "path")
        found, step = after, 2 * step
    longest = found.groupBy("g").agg(F.max("back").alias("_most"))
    return found.join(longest, "g").select(F.col("g").alias(group), F.col("n").alias(id), (F.col("_most") - F.col("back")).alias("position"))
