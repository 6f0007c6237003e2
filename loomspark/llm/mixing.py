"""Operator 9: mixing sources to target weights along a time-varying curriculum.

Each source has a schedule of weights over training time 0..1. The integral of its schedule is the
source's demand curve; a copy of a document that starts after c of the source's target words is due at
the time where that curve reaches c. Documents are range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import SHARES_SEED, WORD, buckets_for, materialise, running_sum

#: Weights by contract of the registered query, repeating over the sources in code point order.
WEIGHTS = (3, 1, 2)
#: Relative schedules (knots of time and weight, linear between them), repeating over the sources likewise.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, place, target) for a table of (source, source_size).

    All targets sum to ``share`` of all sizes. A source's target grows with its weight up to ``most``
    times its size; what is above goes to the others by weight. With sources ordered by
    most * size / weight, the first ones stop at their bound, and one level holds for the rest. The
    window over all sources sees one row a source, not one a document.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(in_order) - 1)
    kinds = F.array(*(F.lit(w) for w in weights))
    placed = placed.withColumn("weight", F.get(kinds, (F.col("place") % len(weights)).cast("int")))
    placed = placed.withColumn("_bound", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_bound") / F.col("weight"), "place")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_bound").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    placed = placed.withColumn("_level", level)
    # the first source whose level does not reach its bound sets the level of all later ones
    open_ = F.when(F.col("_level") * F.col("weight") <= F.col("_bound"), F.col("_level"))
    placed = placed.withColumn("_first", F.first(open_, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.coalesce(F.col("_first") * F.col("weight"), F.col("_bound")))
    return placed.select("source", "source_size", "weight", "place", F.least(target, F.col("_bound")).alias("target"))


def _segments(schedule: tuple) -> list[tuple[float, float, float, float]]:
    """(time, weight, slope, integral so far) of each linear piece, scaled to an integral of one."""
    whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        out.append((t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole, done))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def time_of(share: Column, place: Column, schedules: tuple = SCHEDULES) -> Column:
    """The time at which the integral of the source's schedule is ``share`` (0..1)."""
    out = None
    for k, schedule in enumerate(schedules):
        inside, after = None, None
        for t, w, slope, done in reversed(_segments(schedule)):
            need = share - F.lit(done)
            root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * need, F.lit(0.0)))
            at = F.lit(t) + F.lit(2.0) * need / (F.lit(w) + root)
            inside = at if inside is None else F.when(share < after, at).otherwise(inside)
            after = done
        here = place % len(schedules) == k
        out = F.when(here, inside) if out is None else out.when(here, inside)
    return out


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    schedules: tuple = SCHEDULES,
    rows: int | None = None,
    words: str | None = None,
) -> DataFrame:
    """Add size, source_size, target, taken, copies and positions (the time of each copy) to ``docs``.

    Inside a source, documents stand in the order of a hash of doc_id. Every document is taken
    floor(target / source size) times, and once more if it starts before the rest of the target is
    filled, so a source's words overshoot its target by less than one document. positions is empty
    where nothing is taken. A null source is a source of its own, the last; a null text has size 0 and
    is never taken. Repeated rows are separate documents. Columns of the names added are replaced, and an
    empty table gives an empty result. Reruns agree: nothing depends on the order of the rows. ``words``
    names a column that has the sizes already, so that texts, of any length, need not be read again.
    """
    size = F.col(words) if words else word_count(F.col("text"))
    docs = docs.withColumn("_size", size).drop("size", "source_size", "target", "taken", "copies", "positions").withColumnRenamed("_size", "size")
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    totals = materialise(totals)
    rows = rows or (totals.agg(F.sum("_rows")).first()[0] or 0)
    targets = materialise(source_targets(totals.drop("_rows"), weights, share, most))

    key = F.md5(F.concat_ws("-", F.lit(SHARES_SEED), F.col("doc_id").cast("string")))
    n = buckets_for(rows)
    docs = docs.withColumn("_key", key)
    bucket = (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")
    docs = running_sum(docs, "source", ["_key", "doc_id", "size"], bucket, F.col("size"), "_start")
    docs = docs.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    rest = F.col("target") - whole * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("_start") < rest) & (whole < most)
    docs = docs.withColumn("copies", F.when(F.col("size") > 0, whole + extra.cast("long")).otherwise(0).cast("long"))
    docs = docs.withColumn("taken", F.col("copies") * F.col("size"))
    due = F.transform(
        F.sequence(F.lit(0), F.col("copies").cast("int") - 1),
        lambda k: F.round(F.least(time_of((F.col("_start") + k * F.col("source_size")) / F.col("target"), F.col("place"), schedules), F.lit(1.0)), 9),
    )
    docs = docs.withColumn("positions", F.when(F.col("copies") > 0, due).otherwise(F.array().cast("array<double>")))
    return docs.drop("_key", "_start", "weight", "place")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row for each copy taken, with its ``position``, range-sorted by it."""
    copies = mixed.withColumn("position", F.explode("positions")).drop("positions", "copies", "taken", "target", "source_size", "size")
    return copies.orderBy("position", "doc_id")


def documents_in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each row of ``mixed``: ``columns``, taken as the words of its copies in training order,
    copies, and first_position and last_position in the training order (0 to 1; null if never taken).
    Rows stand in the order of their first copy; those never taken come last.

    The copies are written with their positions, range-sorted, and summed from that table.
    """
    rows = materialise(mixed.select(*dict.fromkeys([*columns, "doc_id", "size"]), "positions", F.monotonically_increasing_id().alias("_row")))
    copies = rows.select("*", F.explode_outer("positions").alias("position")).drop("positions")
    copies = materialise(copies.orderBy(F.col("position").asc_nulls_last(), "doc_id", "_row"))
    words = F.when(F.col("position").between(0.0, 1.0), F.col("size")).otherwise(0)
    out = copies.groupBy("_row").agg(
        *(F.first(c).alias(c) for c in columns), F.sum(words).alias("taken"), F.count("position").alias("copies"),
        F.min("position").alias("first_position"), F.max("position").alias("last_position"),
    )
    out = out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id", "_row")
    return out.select(*columns, "taken", "copies", "first_position", "last_position")


def time_sql(share: str, place: str, schedules: tuple = SCHEDULES) -> str:
    """:func:`time_of` as SQL."""
    kinds = []
    for k, schedule in enumerate(schedules):
        pieces = _segments(schedule)
        at = [f"{t!r} + 2.0::DOUBLE * ({share} - {d!r}) / ({w!r} + sqrt(greatest({w * w!r} + {2 * m!r} * ({share} - {d!r}), 0)))" for t, w, m, d in pieces]
        inside = "".join(f"WHEN {share} < {after[3]!r} THEN {x} " for x, after in zip(at, pieces[1:], strict=False))
        kinds.append(f"WHEN {k} THEN " + (f"CASE {inside}ELSE {at[-1]} END" if inside else at[-1]))
    return f"round(least(CASE {place} % {len(schedules)} {' '.join(kinds)} END, 1.0), 9)"
