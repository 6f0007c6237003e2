"""A log of operator calls: what was asked, how long it took, how many rows came, without secrets."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.structured import redacted

SCHEMA = "call_id string, tool string, input map<string,string>, status string, rows long, latency_ms double, at timestamp"


class Call:
    def __init__(self) -> None:
        self.observation: Observation | None = None

    def observe(self, result: DataFrame, **metrics) -> DataFrame:
        """``result``, counted as it runs: no second pass. The action has to run before the call ends."""
        self.observation = Observation(f"call-{uuid.uuid4().hex}")
        return result.observe(self.observation, F.count(F.lit(1)).alias("rows"), *(v.alias(k) for k, v in metrics.items()))


class QueryLog:
    """A folder to which each call appends one small file, so writers never meet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @contextmanager
    def call(self, tool: str, **given) -> Iterator[Call]:
        """Log what runs inside: tool, redacted input, rows of the observed result (null if none was), latency.
        A failure is logged with the name of its exception and goes on to the caller."""
        call, began, status = Call(), time.perf_counter(), "ok"
        try:
            yield call
        except Exception as e:
            status = type(e).__name__
            raise
        finally:
            took = (time.perf_counter() - began) * 1000
            rows = call.observation.get.get("rows") if call.observation is not None and status == "ok" else None
            text = {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in given.items()}
            entry = self.spark.createDataFrame([(uuid.uuid4().hex, tool, text, status, rows, took)], SCHEMA.rsplit(",", 1)[0])
            entry.withColumns({"input": redacted(F.col("input")), "at": F.current_timestamp()}).coalesce(1).write.mode("append").json(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.path)


def running_metrics(log: DataFrame) -> DataFrame:
    """By tool: calls, failures, rows, mean and longest latency, and the last call's."""
    return log.groupBy("tool").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status") != "ok").alias("failures"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.avg("latency_ms").alias("mean_ms"),
        F.max("latency_ms").alias("most_ms"), F.max_by("latency_ms", F.struct("at", "call_id")).alias("last_ms"),
    )
