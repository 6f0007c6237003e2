"""Evidence compounding, contradiction and the claims ledger, as set operations over sightings.

A sighting is (subject, predicate, object, source, confidence, observed_at, event_id). Keys are shuffled
by edge; the interval operators shuffle by (subject, predicate), so one task owns one fact's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.numbers import clamp, exp, ln, noisy_or, rounded, weakened

EDGE = ["subject", "predicate", "object"]


def strongest_per_source(seen: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """Highest confidence of each source for each edge; sightings without a source share one bucket."""
    source = F.coalesce("source", F.lit("(unknown)")).alias("source")
    return seen.groupBy(*keys, source).agg(F.max(clamp(F.col("confidence"))).alias("confidence"))


def compounded(per_source: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """(keys, sources, confidence): damped noisy-or over one row a source; rows at 0 do not count."""
    positive = per_source.filter("confidence > 0")
    out = positive.groupBy(*keys).agg(
        F.count("*").alias("sources"), F.max("confidence").alias("_m"), F.product(1 - 0.4 * F.col("confidence")).alias("_p")
    )
    return out.select(*keys, "sources", F.round(noisy_or(F.col("_m"), F.col("_p")), 6).alias("confidence"))


def corroborated(seen: DataFrame, least: int = 2, keys: list[str] = EDGE) -> DataFrame:
    """Edges that at least ``least`` distinct sources have seen."""
    return seen.groupBy(*keys).agg(F.count_distinct("source").alias("sources")).filter(F.col("sources") >= least)


def trend(seen: DataFrame, keys: list[str] = EDGE) -> DataFrame:
    """The edge's confidence after each new source, as ``a -> b -> c`` (3 digits), where there are two or more.

    Sources come in the order of their first sighting and count with that confidence; the running
    product and maximum over them give every prefix at once. A source's own digits are often a tie of the
    rounding, so logarithm, exponential and rounding are those of SQL to the last bit.
    """
    order = Window.partitionBy(*keys, "source").orderBy("observed_at", "event_id")
    first = seen.withColumn("_r", F.row_number().over(order)).filter("_r = 1").withColumn("_c", clamp(F.col("confidence")))
    upto = Window.partitionBy(*keys).orderBy("observed_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    steps = first.withColumn("_f", ln(1 - 0.4 * F.col("_c"))).withColumns({"_m": F.max("_c").over(upto), "_s": F.sum("_f").over(upto)})
    steps = steps.withColumn("_n", noisy_or(F.col("_m"), exp("_s")))
    steps = steps.withColumn("_v", F.when(F.col("_m") > 0, rounded(F.col("_n"), 3)).otherwise(0.0))
    listed = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("observed_at", "event_id", "_v"))).alias("_l"))
    shown = F.array_join(F.transform("_l", lambda x: F.format_number(x["_v"], 3)), " -> ")
    return listed.filter(F.size("_l") >= 2).select(*keys, F.size("_l").cast("long").alias("steps"), shown.alias("trend"))


def intervals(seen: DataFrame) -> DataFrame:
    """Validity intervals of functional facts: one for each run of equal objects in time.

    Adds interval, valid_from, valid_to (null: active), closed_by (confidence of the sighting that
    contradicts it) and confidence: all evidence for the same object up to this interval, the first
    confidence of a source in an interval and its highest over intervals, compounded; a closed
    interval is weakened by what closed it. Without evidence above 0 the confidence is 0.
    """
    fact = ["subject", "predicate"]
    time = Window.partitionBy(*fact).orderBy("observed_at", "event_id")
    runs = seen.withColumn("_new", (~F.lag("object").over(time).eqNullSafe(F.col("object"))).cast("int"))
    runs = runs.withColumn("interval", F.sum("_new").over(time))
    key = [*fact, "object", "interval"]
    heads = runs.groupBy(*key).agg(
        F.min("observed_at").alias("valid_from"), F.min_by(clamp(F.col("confidence")), F.struct("observed_at", "event_id")).alias("opened_with")
    )
    later = Window.partitionBy(*fact).orderBy("interval")
    heads = heads.withColumns({"valid_to": F.lead("valid_from").over(later), "closed_by": F.lead("opened_with").over(later)})
    proof = runs.groupBy(*key, "source").agg(F.min_by(clamp(F.col("confidence")), F.struct("observed_at", "event_id")).alias("_c"))
    # what a source adds to the product is the step of its running maximum, so no interval meets its predecessors
    earlier = Window.partitionBy(*fact, "object", "source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    proof = proof.withColumn("_before", F.coalesce(F.max("_c").over(earlier), F.lit(0.0)))
    factor = F.log(1 - 0.4 * F.greatest("_c", "_before")) - F.log(1 - 0.4 * F.col("_before"))
    best = proof.groupBy(*key).agg(F.max("_c").alias("_m"), F.sum(factor).alias("_f"))
    upto = Window.partitionBy(*fact, "object").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    best = best.select(*key, F.max("_m").over(upto).alias("_m"), rounded(F.exp(F.sum("_f").over(upto)), 14).alias("_p"))
    best = best.withColumn("_n", noisy_or(F.col("_m"), F.col("_p")))
    out = heads.join(best.select(*key, rounded(F.col("_n"), 6).alias("confidence")), key, "left")
    out = out.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    closed = F.when(F.col("valid_to").isNull(), F.col("confidence")).otherwise(weakened(F.col("confidence"), F.col("closed_by")))
    out = out.withColumn("_c", closed)
    return out.select(*key, "valid_from", "valid_to", rounded(F.col("closed_by"), 6).alias("closed_by"), rounded(F.col("_c"), 6).alias("confidence"))


def ledger(spans: DataFrame) -> DataFrame:
    """One claim for each interval of a fact that was ever contradicted; superseded_by names the next."""
    fact = Window.partitionBy("subject", "predicate")
    time = fact.orderBy("interval")
    claims = spans.withColumn("_n", F.count("*").over(fact)).filter("_n > 1")
    return claims.select(
        "subject", "predicate", "object", "interval", F.lead("interval").over(time).alias("superseded_by"),
        F.when(F.lead("interval").over(time).isNull(), "active").otherwise("superseded").alias("state"),
    )


def best_claims(seen: DataFrame, keys: list[str]) -> DataFrame:
    """The most confident sighting of each key, the latest and then the highest id of equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence"), F.desc("observed_at"), F.desc("event_id"))
    return seen.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
