"""What several operators share: tables in the shared folder, components, running sums, words.

Lineage is cut by writing Parquet tables below ``spark.checkpoint.dir`` (read from the session), so a
lost executor costs a recomputation of its tasks only. Where the setting is absent, a local session
uses a temporary folder of its process; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, by contract: a run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Mixed into the hash that orders documents inside a source.
SHARES_SEED = "mix-1"
_own_folder: list[str] = []
_worker: list[tuple[tuple, object]] = []


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="loomspark-"))
    return f"file://{_own_folder[0]}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspark_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` as a table in buckets of ``key`` and read it back: later groupings by ``key`` do not shuffle it."""
    spark = df.sparkSession
    name = f"loomspark_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._loomspark_path, out._loomspark_table = path, name
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table written by :func:`materialise` or :func:`bucketed` which no later plan reads."""
    path, name = getattr(df, "_loomspark_path", None), getattr(df, "_loomspark_table", None)
    if path:
        spark = df.sparkSession
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a :func:`materialise` whose tables are deleted at the end of the block."""
    tables: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        tables.append(materialise(df))
        return tables[-1]

    try:
        yield keep
    finally:
        for df in tables:
            release(df)


def worker_table(operator: str, key: object, build: Callable[[], object]) -> object:
    """``build()`` for (operator, key), kept by this Python worker. A worker serves the stages of all
    operators in turn and keeps the tables of one only, so that their sizes do not add up."""
    if not _worker or _worker[0][0] != (operator, key):
        _worker.clear()
        _worker.append(((operator, key), build()))
    return _worker[0][1]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand whole texts to Python in batches of at most ``rows`` rows from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with about ``limit`` bytes of a text column each; a longer text is one part."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    turns = np.flatnonzero(np.diff(np.cumsum(size + 1) // limit)) + 1
    edges = [0, *turns.tolist(), batch.num_rows]
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the smallest node.

    Alternates large-star and small-star steps until the edge table stops changing. Each step takes
    minima with a map-side combine and joins them back, so that no node's neighbours meet in one
    task; the joins have plain exchanges, which adaptive execution splits where a node is hot.
    Null ends and self-loops are ignored; an empty table gives an empty result.
    """
    oriented = (
        edges.filter(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    current, seen = materialise(oriented), None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialise(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        after = materialise(small)
        release(large)
        release(current)
        current = after
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def running_sum(df: DataFrame, group: str, order: list[str], bucket: Column, value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that precede in ``order``.

    ``bucket`` is a coarse, monotone function of ``order``. Rows are summed inside (group, bucket)
    and shifted by the sums of earlier buckets, so a group that holds a third of all rows is spread
    over its buckets and only the table of bucket sums is ordered as a whole.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, "_bucket").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(
        F.col(group).alias("_g"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")
    )
    # written first: its size then decides how it is joined, so the rows need no second shuffle while it is small
    sums = materialise(sums)
    within = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_before", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    out = out.join(sums, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return out.withColumn(name, F.col("_before") + F.col("_offset")).drop("_bucket", "_value", "_before", "_g", "_b", "_offset")


def buckets_for(rows: int, per_bucket: int = 50_000) -> int:
    """How many order buckets keep a bucket near ``per_bucket`` rows; a power of two."""
    n = 1
    while n * per_bucket < rows:
        n *= 2
    return max(n, 16)
