"""Micro-batch versions of the write path. Offsets and checkpoints stand in for leases; a sink keyed by
batch makes a replayed batch harmless."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import evidence as E
from loomspark.operators.curation import valid_envelopes


def unique_events(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key within the delay; the state of older keys is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run over all that is there now, batch by batch, and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(each).start().awaitTermination()


def append_batches(stream: DataFrame, checkpoint: str, target: str) -> None:
    """Append each batch under ``target/batch=n``; running a batch again overwrites its own folder only."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    drain(stream, checkpoint, each)


def quarantine_stream(events: DataFrame, checkpoint: str, target: str, quarantine: str) -> None:
    """Write each batch's valid envelopes below ``target`` and the others, with their problem, below ``quarantine``;
    a batch that runs again replaces its own rows in both."""

    def each(batch: DataFrame, number: int) -> None:
        judged = valid_envelopes(batch).persist()
        judged.filter("problem IS NULL").drop("problem").write.mode("overwrite").parquet(f"{target}/batch={number}")
        judged.filter("problem IS NOT NULL").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        judged.unpersist()

    drain(events, checkpoint, each)


def rescore_stream(sightings: DataFrame, checkpoint: str, evidence: str, scores: str) -> None:
    """Append sightings to the evidence table; after each batch recompute the edges it touched.

    Scores are a function of the evidence of an edge alone, so any order of arrival ends at the same
    result. The latest batch of an edge holds its score.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{evidence}/batch={number}")
        touched = batch.select(*E.EDGE).distinct()
        known = spark.read.parquet(evidence).filter(F.col("batch") <= number).drop("batch")
        own = known.join(touched, E.EDGE, "left_semi")
        E.compounded(E.strongest_per_source(own)).write.mode("overwrite").parquet(f"{scores}/batch={number}")

    drain(sightings, checkpoint, each)


def current_scores(scores: DataFrame) -> DataFrame:
    """The last score of each edge."""
    return scores.groupBy(*E.EDGE).agg(F.max_by(F.struct("sources", "confidence"), "batch").alias("s")).select(*E.EDGE, "s.*")
