"""A stored inverted index for full text: blocks of postings with their largest impact, appended by batch.

A posting is (document, occurrences of a stem); its impact is n / (n + 1), and a document's score the sum
over the distinct stems of a query. Postings of one stem are kept in blocks by fixed ranges of document ids,
so a block has a bounded length, however frequent its stem is. A search reads the blocks' impacts first: the
sum of a range's largest impacts bounds the score of any document in it. The ranges with the highest bounds
are scored, and of the others only those whose bound reaches the score that is then the k-th.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.stems import with_stem
from loomspark.functions.text import STOP_WORDS, tokens
from loomspark.operators.lineage import new_folder, removed

#: Document ids of a block share all but so many low bits; folders that stems are hashed to; files of a folder and batch at most.
RANGE_BITS, BUCKETS, SLICES = 8, 16, 16
#: Ranges of a query scored first.
FIRST = 4
#: Beyond so many words of all queries together, or ranges, blocks are found by a join and not by a pushed filter.
PUSHED = 1000
SCHEMA = "term string, range long, docs array<long>, counts array<int>, impact double, bucket int, batch string"
WORDS = "doc_id long, word string, n int"


def words(rows: DataFrame, text: str = "text") -> DataFrame:
    """How often (n) each row's ``text`` has each word that is no stop word; the text is dropped."""
    kept = [c for c in rows.columns if c != text]
    found = rows.select(*kept, F.explode(tokens(F.col(text))).alias("word")).filter(~F.col("word").isin(*STOP_WORDS))
    return found.groupBy(*kept, "word").agg(F.count("*").cast("int").alias("n"))


def postings(counted: DataFrame) -> DataFrame:
    """(doc_id, term, range, bucket, slice, n) of (doc_id, word, n). Texts repeat their words, and each other's: each word is stemmed once."""
    # words are few beside the rows that have them: rows that meet a table of their part's words need no sort
    stems = with_stem(counted.select("word").distinct()).hint("shuffle_hash")
    place = {"range": F.shiftright("doc_id", RANGE_BITS), "bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")}
    rows = counted.join(stems, "word").drop("word").withColumns(place).withColumn("slice", F.pmod(F.xxhash64("range"), F.lit(SLICES)).cast("int"))
    # one shuffle serves the sums, the blocks and their folders
    return rows.repartition("bucket", "slice").groupBy("bucket", "slice", "term", "range", "doc_id").agg(F.sum("n").cast("int").alias("n"))


def blocked(found: DataFrame) -> DataFrame:
    """Postings gathered by (term, range of ids): at most 2 ** RANGE_BITS a block."""
    own = F.sort_array(F.collect_list(F.struct("doc_id", "n")))
    out = found.groupBy("bucket", "slice", "term", "range").agg(own.alias("p"), F.max(F.col("n") / (F.col("n") + 1.0)).alias("impact"))
    return out.select("term", "range", F.col("p.doc_id").alias("docs"), F.col("p.n").alias("counts"), "impact", "bucket")


def append(path: str, docs: DataFrame, batch: str, id: str = "doc_id", text: str = "text") -> None:
    """Index a batch of documents that the index does not have yet. Running a batch again replaces its own part only."""
    spark, own = docs.sparkSession, new_folder(docs.sparkSession, "words")
    # a document's words are counted where its text is; they are kept, being read twice
    words(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartition("doc_id")).write.parquet(own)
    made = blocked(postings(spark.read.schema(WORDS).parquet(own))).sortWithinPartitions("bucket", "term", "range")
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}")
    removed(spark, own)
    # the driver makes little garbage: without this the shuffles of all batches stay on disk together
    spark._jvm.System.gc()


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, bucket): the distinct stems of each query (query_id, text)."""
    terms = with_stem(words(queries.select("query_id", "text"))).select("query_id", "term").distinct()
    return terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def wanted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The blocks of the queries' stems: folders and row groups of others are not read."""
    some = terms.select("term", "bucket").distinct().limit(PUSHED + 1).collect()  # the words that the caller gives
    if len(some) <= PUSHED:
        return index.filter(F.col("bucket").isin(sorted({r.bucket for r in some})) & F.col("term").isin([r.term for r in some]))
    return index.join(terms.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")


def _scored(blocks: DataFrame, terms: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every document of the given (query_id, range) that has a stem of the query."""
    some = ranges.select("range").distinct().limit(PUSHED + 1).collect()
    if len(some) <= PUSHED:
        blocks = blocks.filter(F.col("range").isin([r.range for r in some]))
    own = blocks.select("term", "range", "docs", "counts").join(terms.select("query_id", "term"), "term").join(ranges.select("query_id", "range"), ["query_id", "range"])
    rows = own.select("query_id", F.explode(F.arrays_zip("docs", "counts")).alias("p")).select("query_id", F.col("p.docs").alias("doc_id"), F.col("p.counts").alias("n"))
    return rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("n") / (F.col("n") + 1.0)), 6).alias("score"))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k first of each query; Spark keeps k a partition before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: DataFrame, queries: DataFrame, k: int = 10, first: int = FIRST, told: dict | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query (query_id, text), ties by id.

    The result is that of scoring all documents. Queries without a stem that the index has give no row.
    ``told`` gets the numbers of ranges that hold a stem of a query, and of those that were scored.
    """
    terms = query_terms(queries).cache()
    blocks = wanted(index, terms)
    bounds = blocks.select("term", "range", "impact").join(terms.select("query_id", "term"), "term")
    # batches may each have a block of one range: the larger impact bounds both
    bounds = bounds.groupBy("query_id", "range", "term").agg(F.max("impact").alias("i")).groupBy("query_id", "range").agg(F.sum("i").alias("bound")).cache()
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    head = bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= first)
    found = _best(_scored(blocks, terms, head), k).drop("rank").cache()
    # with fewer than k hits any range may still give one
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("least"))
    rest = bounds.join(head.select("query_id", "range"), ["query_id", "range"], "left_anti").join(least, "query_id")
    rest = rest.filter(F.col("bound") + 1e-6 >= F.col("least")).cache()
    if told is not None:
        told |= {"ranges": bounds.count(), "scored": head.count() + rest.count()}
    return _best(found.unionByName(_scored(blocks, terms, rest)), k)


def matching(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, total): how many documents have a stem of each query."""
    # kept, as in search: a join would push its filter on the term through all steps of the stem, one copied into the next
    terms = query_terms(queries).cache()
    # a block's documents are bits of a few numbers, made once a block however many queries have its stem
    masks = [f"_m{i}" for i in range(2**RANGE_BITS // 64)]
    bits = "aggregate(docs, 0L, (m, d) -> m | if((shiftright(d, 6) & {}) = {}, shiftleft(1L, CAST(d & 63 AS INT)), 0L)) AS {}"
    blocks = wanted(index, terms).selectExpr("term", "range", *(bits.format(len(masks) - 1, i, m) for i, m in enumerate(masks)))
    own = blocks.join(terms.select("query_id", "term"), "term").groupBy("query_id", "range").agg(*(F.bit_or(m).alias(m) for m in masks))
    # a null id has no range
    found = F.when(F.col("range").isNull(), 1).otherwise(sum((F.bit_count(m) for m in masks), F.lit(0)))
    return own.groupBy("query_id").agg(F.sum(found).alias("total"))
