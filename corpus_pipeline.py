"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

1. the quality classifier rejects documents it scores below 0.7;
2. line dedup deletes blocks that an earlier document holds, and documents of which nothing is left;
3. of each group of near copies (five-word shingles, Jaccard 0.75) the smallest doc_id stays;
4. sources are mixed to their target weights: a row for each copy taken, written in training order;
5. every text is encoded by byte-level BPE; rows keep the training order and carry their place in it.

Columns of ``documents`` beyond its own pass through all but the last stage, whatever their names. Null
texts count as empty for the classifier, which decides on them; what is left of them after stage 2 has no
word and goes there only if a deletion emptied it, and stage 4 takes no document without words. Rows that
repeat pass stage 1 and 2 together and are one group in stage 3, where rows with a null doc_id stay. Equal
scores, ids and positions are decided by doc_id, or are the same row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, byte_cnn, jaccard_join, line_dedup, mixing
from loomspark.llm.shared import WORD, materialise, small_batches

#: Columns that the operators add or replace.
ADDED = ("score", "predicted", "n_lines", "n_deleted", "size", "source_size", "target", "taken", "copies", "positions", "position")


def _around(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``docs``, whose columns with names of ADDED stand aside meanwhile; the columns of ``docs``."""
    aside = {c: f"_aside_{c}" for c in docs.columns if c.lower() in ADDED}
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    net = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _around(docs, lambda d: byte_cnn.score(d, net).filter("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)

    def step(docs: DataFrame) -> DataFrame:
        done = line_dedup.dedup_lines(docs)
        done = done.filter((F.col("n_deleted") == 0) | F.col("text").rlike(WORD))
        if "n_chars" in docs.columns:
            changed = F.length("text").cast(docs.schema["n_chars"].dataType)
            done = done.withColumn("n_chars", F.when(F.col("n_deleted") > 0, changed).otherwise(F.col("n_chars")))
        return done

    return _around(docs, step)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard_join.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _around(docs, lambda d: mixing.in_training_order(mixing.mix(d)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    # the stage before wrote its rows range-sorted: file name and row tell their place
    place = {"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")}
    placed = docs.select("doc_id", "source", "lang", "text", *(c.alias(name) for name, c in place.items()))
    return bpe.encode(placed.orderBy("file", "row"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: A learned classifier decides the first stage, so SQL cannot give the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
