"""A stored index of three-character parts, for substring search in names without reading them all.

A name holds a part of three characters or more only if it holds all of the part's grams. The shortest lists
among these grams are intersected, and only the names left are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lists of a part that are intersected; ids of a block share all but so many low bits; folders of grams.
LISTS, RANGE_BITS, BUCKETS = 3, 12, 16
SCHEMA = "gram string, range long, ids array<long>, bucket int, batch string"


def grams(text: Column) -> Column:
    """The distinct runs of three characters, in lower case; empty for shorter texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    last = F.length(low) - 2
    # a sequence runs downwards where its end is smaller, so short texts are told apart first
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(
        F.array().cast("array<string>")
    )


def append(path: str, names: DataFrame, batch: str, id: str, name: str) -> None:
    """Index a batch of names; running it again replaces its own part only. Null names and ids are not found."""
    rows = names.filter(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("id"), F.explode(grams(F.col(name))).alias("gram"))
    lists = rows.groupBy("gram", F.shiftright("id", RANGE_BITS).alias("range")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    lists = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
    lists.repartition("bucket").sortWithinPartitions("bucket", "gram", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def holding(index: DataFrame, names: DataFrame, parts: DataFrame, id: str, name: str) -> DataFrame:
    """(query_id, id, name) for each of ``parts`` (query_id, part) and each name that holds it, in any case.

    Parts shorter than three characters have no gram and are an error of the caller; they find nothing here.
    """
    low = parts.select("query_id", F.lower("part").alias("part")).filter(F.length("part") >= 3)
    asked = low.select("query_id", "part", F.explode(grams(F.col("part"))).alias("gram"))
    asked = asked.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")).cache()
    some = asked.select("gram", "bucket").distinct().limit(1001).collect()  # of the parts that the caller gives
    lists = index.filter(F.col("bucket").isin(sorted({r.bucket for r in some})))
    lists = lists.filter(F.col("gram").isin([r.gram for r in some])) if len(some) <= 1000 else lists.join(asked.select("gram", "bucket").distinct(), ["gram", "bucket"], "left_semi")
    # a gram that no name has leaves its part without a match: it counts 0 and is the rarest
    sizes = lists.groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
    rarest = Window.partitionBy("query_id").orderBy("n", "gram")
    chosen = asked.join(sizes, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chosen = chosen.withColumn("r", F.row_number().over(rarest)).filter(F.col("r") <= LISTS).select("query_id", "part", "gram")
    needed = chosen.groupBy("query_id").agg(F.count("*").alias("needed"))
    hits = lists.select("gram", F.explode("ids").alias("_id")).join(chosen, "gram")
    kept = hits.groupBy("query_id", "part", "_id").agg(F.count_distinct("gram").alias("has")).join(needed, "query_id").filter("has = needed")
    texts = names.select(F.col(id).cast("long").alias("_id"), F.col(name).alias("name"))
    return kept.select("query_id", "part", "_id").join(texts, "_id").filter(F.contains(F.lower("name"), F.col("part"))).select("query_id", F.col("_id").alias("id"), "name").distinct()
