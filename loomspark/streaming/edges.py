"""Edges kept live in a stream: the state of an edge is what each of its sources has shown, and its score.

Three streams follow each other, each with native state that a batch reads and writes for its own keys only: the
highest confidence a source has shown for an edge, what that was before, and the edge's sums over all of it. The
sightings are not read again, and no edge's sources are ever together in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.numbers import clamp, noisy_or, rounded
from loomspark.operators.evidence import EDGE
from loomspark.operators.lineage import made
from loomspark.streaming.pipelines import drain

#: Fixed values of the compounding formula.
DAMPING = 0.4
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What the streams hand on, below the checkpoint.
SHOWN = "subject long, predicate string, object string, source string, confidence double"
RAISED = "subject long, predicate string, object string, confidence double, before double"


def shown(sightings: DataFrame) -> DataFrame:
    """The sources whose highest confidence for an edge a batch of ``sightings`` (subject, predicate, object, source,
    confidence) has raised, with it. Null sources are one source; null confidences count 0.

    The time is that of the batch, also when it is run again; a source that repeats its confidence keeps the earlier one.
    """
    now, source = F.current_timestamp(), F.coalesce("source", F.lit("(unknown)"))
    rows = sightings.select(*EDGE, source.alias("source"), (-clamp(F.col("confidence"))).alias("c"), now.alias("at"))
    best = rows.groupBy(*EDGE, "source").agg(F.min(F.struct("c", "at")).alias("s"))
    return best.filter(F.col("s.at") == now).select(*EDGE, "source", (0.0 - F.col("s.c")).alias("confidence"))


def raised(maxima: DataFrame) -> DataFrame:
    """Each source's highest confidence for an edge now and before (0 at first); the state has the steps in between."""
    now = F.current_timestamp()
    rows = maxima.select(*EDGE, "source", F.struct("confidence", now.alias("at")).alias("step"))
    steps = rows.groupBy(*EDGE, "source").agg(F.collect_set("step").alias("s"))
    earlier = F.array_max(F.transform(F.filter("s", lambda x: x["at"] != now), lambda x: x["confidence"]))
    out = steps.select(*EDGE, F.array_max("s")["confidence"].alias("confidence"), earlier.alias("before"))
    out = out.filter(F.col("before").isNull() | (F.col("confidence") > F.col("before")))
    return out.withColumn("before", F.coalesce("before", F.lit(0.0)))


def live_edges(raises: DataFrame) -> DataFrame:
    """The edges that a batch of ``raised`` rows touches, with created (made by this batch), sources and confidence.

    A raise changes the product by the quotient of its source's new and old factors, so a batch costs what it brings
    and not what the edge has gathered.
    """
    now, c, before = F.current_timestamp(), F.col("confidence"), F.col("before")
    sums = raises.withColumn("at", now).groupBy(*EDGE).agg(
        F.count_if((c > 0) & (before == 0)).alias("sources"), F.max(c).alias("strongest"), F.min("at").alias("at"),
        F.product((1 - DAMPING * c) / (1 - DAMPING * before)).alias("product"),
    )
    scored = sums.withColumn("n", noisy_or(F.col("strongest"), F.col("product")))
    score = F.when(F.col("sources") > 0, rounded(F.col("n"), 6)).otherwise(0.0)
    return scored.select(*EDGE, F.sha2(F.concat_ws("|", *EDGE), 256).alias("edge_id"), (F.col("at") == now).alias("created"), "sources", score.alias("confidence"))


def run_live_edges(sightings: DataFrame, checkpoint: str, target: str) -> None:
    """Drain the stream; each batch's rows go to ``target/batch=n``, where a repeated batch replaces its own.

    The streams run one after the other, so each finds whole batches only; what the first two hand on stands below
    ``checkpoint``. A batch of edges is what all batches of sightings of one call have raised.
    """
    spark = sightings.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)

    def step(stream: DataFrame, own: str, to: str) -> None:
        drain(stream, f"{checkpoint}/{own}", lambda batch, number: batch.write.mode("overwrite").parquet(f"{to}/batch={number}"), "update")

    def handed(own: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).parquet(made(spark, f"{checkpoint}/{own}-rows"))

    spark.conf.set(name, ROCKS)
    try:
        step(shown(sightings), "shown", f"{checkpoint}/shown-rows")
        step(raised(handed("shown", SHOWN)), "raised", f"{checkpoint}/raised-rows")
        step(live_edges(handed("raised", RAISED)), "edges", target)
    finally:
        spark.conf.set(name, before)


def edges_now(rows: DataFrame) -> DataFrame:
    """The last row of each edge, and the batch that made it."""
    made = F.min(F.when(F.col("created"), F.col("batch"))).alias("made_in")
    last = rows.groupBy(*EDGE).agg(F.max_by(F.struct("edge_id", "sources", "confidence"), "batch").alias("s"), made)
    return last.select(*EDGE, "s.*", "made_in")


def sessions(notes: DataFrame, actor: str, at: str, gap: str, delay: str) -> DataFrame:
    """Sessions made from a stream of notes: those of one actor with less than ``gap`` between them.

    A session is given once, when the watermark (the latest time less ``delay``) has passed its end, which
    is ``gap`` after its last note. A note later than the watermark opens or lengthens no session: it is
    dropped, and the sink of late notes is the caller's. Columns: actor, session_id, started_at, ended_at,
    notes.
    """
    window = F.session_window(at, gap)
    out = notes.withWatermark(at, delay).groupBy(actor, window.alias("w")).agg(F.count("*").alias("notes"), F.max(at).alias("ended_at"))
    return out.select(actor, F.sha2(F.concat_ws("|", F.col(actor).cast("string"), F.unix_micros("w.start").cast("string")), 256).alias("session_id"), F.col("w.start").alias("started_at"), "ended_at", "notes")
