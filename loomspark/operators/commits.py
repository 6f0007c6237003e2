"""Several tables that change together: a batch counts once its manifest is there.

Each table keeps the rows of a batch in a folder of its own. The manifest of a batch is one small file, written
last and put in place by a rename; readers take the folders of batches that have one. A run that dies between
two tables leaves folders that nobody reads, and its repetition replaces them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.memory import keep_latest


class BatchStore:
    """Tables below ``path``, named by the caller, whose rows come in batches with names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_batches")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def committed(self) -> list[str]:
        """Names of the whole batches, a list of one file each."""
        fs, where = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if not s.getPath().getName().startswith("_")) if fs.exists(where) else []

    def read(self, table: str, schema: str, batches: list[str] | None = None) -> DataFrame:
        """The rows of ``table`` in committed batches (or those named), with ``batch``: only their folders are read."""
        named = self.committed() if batches is None else batches
        paths = [f"{self.path}/{table}/batch={b}" for b in named]
        fs, _ = self._files()
        paths = [p for p in paths if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p))]
        full = f"{schema}, batch string"
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{table}").parquet(*paths)

    def commit(self, batch: str, tables: dict[str, DataFrame], between: Callable[[str], None] = lambda table: None) -> bool:
        """Write the rows of one batch and its manifest; False, and nothing done, if the batch is there already.

        ``between`` is called behind each table, for tests of what a dead run leaves.
        """
        if not batch or "/" in batch or batch.startswith("_"):
            raise ValueError("a batch needs a name without slashes that does not begin with _")
        if batch in self.committed():
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
            between(name)
        fs, where = self._files()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        made = path(where, f"_{batch}")
        out = fs.create(made, True)
        out.write(bytearray(",".join(tables).encode()))
        out.close()
        return bool(fs.rename(made, path(where, batch)))


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], version: str, buckets: int = 64) -> DataFrame:
    """Merge ``batch`` into the table at ``path``, of each key the row of the highest version, of equals the batch's.

    The table is kept in folders by a hash of the key. Only folders that the batch touches are read and
    replaced (dynamic partition overwrite); all other files stay. Returns the changes: key columns, op
    (insert or update) and the row's columns before (``old``) and after (``new``); rows that a merge leaves
    as they are give none. The changes are written first, below ``path``_changes, so a repetition of a
    failed call gives the same table. Null keys are keys like any other.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    new = batch.withColumn("_bucket", bucket)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # at most ``buckets``
    stored = spark.read.schema(new.schema).parquet(path).filter(F.col("_bucket").isin(touched)) if there else spark.createDataFrame([], new.schema)
    merged = keep_latest(stored, new, [*keys, "_bucket"], version)
    rest = [c for c in batch.columns if c not in keys]
    old = stored.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*rest).alias("old"))
    on = [merged[k].eqNullSafe(old[f"_k{i}"]) for i, k in enumerate(keys)]
    row = F.struct(*(F.col(c) for c in rest))
    both = merged.withColumn("new", row).join(old, on, "left")
    # both come from the files that are about to be replaced: written aside first
    aside = f"{path.rstrip('/')}_changes"
    both.select(*keys, "_bucket", "old", "new").write.mode("overwrite").parquet(aside)
    held = spark.read.schema(both.select(*keys, "_bucket", "old", "new").schema).parquet(aside)
    table = held.select(*keys, "new.*", "_bucket").select(*batch.columns, "_bucket")
    table.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    changed = held.filter(~F.col("old").eqNullSafe(F.col("new")))
    return changed.select(*keys, F.when(F.col("old").isNull(), "insert").otherwise("update").alias("op"), "old", "new")


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")
