"""Queries of the retrieval family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import ranking as R
from loomspark.plans.views import DOCS_SQL, TOKENS, docs, query_text, query_vector, vectors
from loomspark.registry import query, table

STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
VEC = "list_transform({}, lambda x: x::DOUBLE)"
Q_SQL = f"q AS (SELECT {VEC.format('embedding')} AS e FROM embeddings WHERE vec_id = 7)"
#: Candidates, BM25 and its scaling over CTEs docs and q: {k} candidates, {qt} the query's terms, {p} ends the names.
BM25_SQL = f"""cand{{p}} AS (SELECT d.*, round(list_cosine_similarity({VEC.format("v.embedding")}, q.e), 6) AS sim
  FROM docs d JOIN embeddings v ON d.doc_id = v.vec_id, q ORDER BY sim DESC, d.doc_id LIMIT {{k}}),
tok{{p}} AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM cand{{p}}),
n{{p}} AS (SELECT c.doc_id, count(t.term) AS n FROM cand{{p}} c LEFT JOIN tok{{p}} t USING (doc_id) GROUP BY c.doc_id),
stat{{p}} AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM n{{p}}),
tf{{p}} AS (SELECT doc_id, term, count(*) AS tf FROM tok{{p}} GROUP BY ALL),
df{{p}} AS (SELECT term, count(*) AS df FROM tf{{p}} GROUP BY term),
qt{{p}} AS (SELECT term, count(*) AS w FROM ({{qt}}) GROUP BY term),
part{{p}}_ AS (SELECT f.doc_id, sum(w * ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n.n / avg_len))) AS s
  FROM tf{{p}} f JOIN qt{{p}} USING (term) JOIN df{{p}} USING (term) JOIN n{{p}} n USING (doc_id), stat{{p}} GROUP BY f.doc_id),
bm{{p}} AS (SELECT c.*, round(coalesce(s, 0::DOUBLE), 6) AS bm25 FROM cand{{p}} c LEFT JOIN part{{p}}_ USING (doc_id)),
mm{{p}} AS (SELECT *, CASE WHEN max(bm25) OVER () = min(bm25) OVER () THEN 0::DOUBLE
  ELSE round((bm25 - min(bm25) OVER ()) / (max(bm25) OVER () - min(bm25) OVER ()), 6) END AS text_score FROM bm{{p}})"""
QUERY_TERMS = f"SELECT unnest({TOKENS.format('text')}) AS term FROM benchmark WHERE item_id = 3"
CAND_SQL = f"{DOCS_SQL}, {Q_SQL}, {BM25_SQL.format(k=30, qt=QUERY_TERMS, p='')}"


@query(f"WITH {Q_SQL} SELECT vec_id, label, round(list_cosine_similarity({VEC.format('embedding')}, q.e), 6) AS sim FROM embeddings, q ORDER BY sim DESC, vec_id LIMIT 20")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.nearest(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20)


@query(f"SELECT doc_id, len({TOKENS.format('text')})::BIGINT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = R.nearest_docs(docs(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), 30)
    return R.bm25(near, query_text(spark, sf_dir))


@query(f"WITH {CAND_SQL} SELECT doc_id, sim, bm25 FROM bm")
def bm25_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir).select("doc_id", "sim", "bm25")


@query(f"WITH {CAND_SQL} SELECT doc_id, bm25, text_score FROM mm")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.min_max(_candidates(spark, sf_dir), "bm25", "text_score").select("doc_id", "bm25", "text_score")


def _hybrid(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    return R.hybrid(docs(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), limit)


HYBRID_SQL = f"{CAND_SQL}, hyb AS (SELECT *, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score, 6) AS score FROM mm ORDER BY score DESC, doc_id LIMIT 10)"


@query(f"WITH {HYBRID_SQL} SELECT doc_id, sim, bm25, text_score, score FROM hyb")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir).select("doc_id", "sim", "bm25", "text_score", "score")


@query(f"WITH {CAND_SQL} SELECT doc_id, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score, 6) AS score FROM mm ORDER BY score DESC, doc_id LIMIT 5 OFFSET 5")
def hybrid_second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.hybrid(docs(spark, sf_dir), vectors(spark, sf_dir), query_vector(spark, sf_dir), query_text(spark, sf_dir), 5, offset=5)
    return found.select("doc_id", "score")


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as entities, each named by its name; orders as mentions in a document."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    item = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("doc_id"))
    return part, item


@query("""WITH t AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) > 1)) AS t FROM part WHERE p_partkey = 1),
e AS (SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM t WHERE contains(lower(p_name), t.t)) ORDER BY length(p_name) DESC, p_partkey LIMIT 5),
r AS (SELECT p_partkey, [0.4::DOUBLE, 0.25, 0.15, 0.08, 0.04][row_number() OVER (ORDER BY length(p_name) DESC, p_partkey)] AS b FROM e)
SELECT doc_id, round(sum(b), 6) AS boost FROM (SELECT DISTINCT l_partkey, l_orderkey AS doc_id FROM lineitem) JOIN r ON r.p_partkey = l_partkey GROUP BY doc_id""")
def closet_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities, mentions = _entities(spark, sf_dir)
    name = entities.filter("entity_id = 1").first()["name"]
    return R.entity_boosts(entities, mentions, name)


FULLTEXT_SQL = f"""{DOCS_SQL}, qw AS (SELECT DISTINCT unnest({TOKENS.format("text")}) AS term FROM benchmark WHERE item_id = 3),
tok AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS n FROM tok JOIN qw USING (term) GROUP BY ALL),
ft AS (SELECT doc_id, round(sum(n / (n + 1.0::DOUBLE)), 6) AS score FROM tf GROUP BY doc_id)"""


@query(f"WITH {FULLTEXT_SQL} SELECT doc_id, score FROM ft ORDER BY score DESC, doc_id LIMIT 20")
def fulltext_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.full_text(docs(spark, sf_dir), query_text(spark, sf_dir))
    return found.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {FULLTEXT_SQL} SELECT count(*) AS total FROM ft JOIN docs USING (doc_id) WHERE lang = 'en'")
def fulltext_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.full_text(docs(spark, sf_dir).filter("lang = 'en'"), query_text(spark, sf_dir))
    return found.agg(F.count("*").alias("total"))


RRF_SQL = f"""{FULLTEXT_SQL}, {Q_SQL},
l AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS r FROM (SELECT vec_id AS doc_id, round(list_cosine_similarity({VEC.format("embedding")}, q.e), 6) AS sim
  FROM embeddings JOIN docs ON doc_id = vec_id, q ORDER BY sim DESC, doc_id LIMIT 20)),
t AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (SELECT * FROM ft ORDER BY score DESC, doc_id LIMIT 20))"""


@query(f"""WITH {RRF_SQL} SELECT coalesce(l.doc_id, t.doc_id) AS doc_id, round(coalesce(1::DOUBLE / (60 + l.r), 0) + coalesce(1::DOUBLE / (60 + t.r), 0), 6) AS score
FROM l FULL OUTER JOIN t ON l.doc_id = t.doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors(spark, sf_dir).join(docs(spark, sf_dir).select("doc_id"), "doc_id", "left_semi")
    near = R.nearest(own, query_vector(spark, sf_dir), 20, "doc_id")
    words = R.full_text(docs(spark, sf_dir), query_text(spark, sf_dir)).orderBy(F.desc("score"), "doc_id").limit(20)
    fused = R.rrf(R.with_rank(near, F.desc("sim"), F.asc("doc_id")), R.with_rank(words, F.desc("score"), F.asc("doc_id")), "doc_id")
    return fused.orderBy(F.desc("score"), "doc_id").limit(20)


@query(f"WITH {FULLTEXT_SQL} SELECT ft.doc_id, score FROM ft JOIN docs USING (doc_id) WHERE workspace = 'src3' ORDER BY score DESC, ft.doc_id LIMIT 10")
def recall_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = docs(spark, sf_dir).filter("workspace = 'src3'")
    return R.full_text(own, query_text(spark, sf_dir)).select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(10)


@query(f"""WITH {HYBRID_SQL} SELECT doc_id, score, round(0.7::DOUBLE * score + 0.3::DOUBLE * (1 - (row_number() OVER (ORDER BY created_at DESC, doc_id) - 1) / count(*) OVER ()), 6) AS reranked FROM hyb""")
def recency_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.recency(_hybrid(spark, sf_dir)).select("doc_id", "score", "reranked")


@query(f"""WITH {HYBRID_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, greatest(1, ceil(length(text) / 4))::BIGINT AS tokens FROM hyb),
c AS (SELECT *, sum(tokens) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM r)
SELECT doc_id, rank, CASE WHEN rank = 1 AND upto > 3000 THEN 3000 ELSE tokens END::BIGINT AS tokens, rank = 1 AND upto > 3000 AS truncated FROM c WHERE upto <= 3000 OR rank = 1""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.with_rank(_hybrid(spark, sf_dir), F.desc("score"), F.asc("doc_id"))
    return R.token_budget(ranked, 3000).select("doc_id", F.col("rank").cast("long").alias("rank"), "tokens", "truncated")


@query(f"""WITH {CAND_SQL}, top AS (SELECT * FROM (SELECT *, round(0.6::DOUBLE * sim + 0.4::DOUBLE * text_score, 6) AS score FROM mm) ORDER BY score DESC, doc_id LIMIT 5)
SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS.format("text")}) AS term FROM top) WHERE term NOT IN ({STOP_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 10""")
def prf_two_pass_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _hybrid(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(5)
    return R.expansion_terms(first, T.STOP_WORDS)


@query(f"""WITH {CAND_SQL}, a AS (SELECT doc_id, sim AS score FROM cand), b AS (SELECT doc_id, text_score AS score FROM mm)
SELECT doc_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""")
def merge_hit_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.min_max(_candidates(spark, sf_dir), "bm25", "text_score")
    return R.merge_best(found.select("doc_id", F.col("sim").alias("score")), found.select("doc_id", F.col("text_score").alias("score")))


@query(f"""WITH {DOCS_SQL} SELECT doc_id, source, lang FROM docs WHERE lang IN ('en', 'de')
AND created_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'""")
def search_filters_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).filter(F.col("lang").isin("en", "de"))
    return d.filter("created_at BETWEEN timestamp_ntz'2024-01-03 00:00:00' AND timestamp_ntz'2024-01-20 00:00:00'").select("doc_id", "source", "lang")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey AND p_brand = 'Brand#13')""")
def search_filter_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("l_partkey"))
    hits = table(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(hits, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query(f"""WITH {HYBRID_SQL}, p AS (SELECT doc_id, created_at, lang AS type, score FROM hyb), t AS (SELECT type || ':' || count(*) AS x FROM p GROUP BY type)
SELECT count(*) AS hits, round(avg(score), 6) AS mean_score, min(score) AS min_score, max(score) AS max_score, min(created_at) AS earliest, max(created_at) AS latest,
count(DISTINCT doc_id) AS documents, (SELECT string_agg(x, ',' ORDER BY x) FROM t) AS by_type FROM p""")
def retrieval_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.result_metadata(_hybrid(spark, sf_dir).select("doc_id", "created_at", F.col("lang").alias("type"), "score"))
