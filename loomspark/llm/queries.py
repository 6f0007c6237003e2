"""One query per operator over its whole table, and the SQL that defines its rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, byte_cnn, fill_middle, hidden_markov, jaccard_join, line_dedup, mixing, prefix_trie, quality_rules
from loomspark.llm import sharding, token_counts, url_filters, vector_dedup
from loomspark.llm.shared import materialise, small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "alias_group", "group_pages")


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.drop("failed_rules")


ORACLE_SQL["op3_quality_rules"] = quality_rules.oracle_sql()


@query
def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    placed = sharding.kd_shards(docs, size, sharding.document_dimensions(size), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the texts are read once, for their sizes
    sized = materialise(table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    return mixing.documents_in_order(mixing.mix(sized, words="words"), ["doc_id", "size", "source_size", "target"])


ORACLE_SQL["op9_source_mix"] = (
    r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
b AS (SELECT *, [3, 1, 2][place % 3 + 1] AS weight, 2::DOUBLE * source_size AS bound FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(bound) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM b WINDOW o AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, first_value(CASE WHEN level * weight <= bound THEN level END IGNORE NULLS)
  OVER (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_level FROM l),
t AS (SELECT source, source_size, place, CASE WHEN source_size = 0 THEN 0 ELSE least(coalesce(first_level * weight, bound), bound) END::DOUBLE AS target FROM f),
c AS (SELECT doc_id, size, source_size, target, place, floor(target / source_size)::BIGINT AS whole,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1-' || doc_id), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN start < target - whole * source_size AND whole < 2 THEN 1 ELSE 0 END END::BIGINT AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies,
"""
    + f"""  CASE WHEN copies > 0 THEN {mixing.time_sql("(start / target)", "place")} END AS first_position,
  CASE WHEN copies > 0 THEN {mixing.time_sql("((start + (copies - 1) * source_size) / target)", "place")} END AS last_position FROM n"""
)

#: Links as url_filters.html_links finds them, but for steps up in relative ones; components by a recursive query.
ORACLE_SQL["op2_url_filters"] = r"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages),
tag AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM u),
named AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END), '&amp;', '&') AS link FROM tag),
hop AS (SELECT url AS src, CASE WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
  WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || link WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)^.*?://[^?#]*') || link
  WHEN starts_with(link, '#') THEN url ELSE regexp_replace(regexp_extract(url, '(?s)^.*?://[^?#]*'), '[^/]*$', '') || link END AS dst FROM named WHERE link <> ''),
every AS (SELECT url FROM u UNION SELECT src FROM hop UNION SELECT dst FROM hop),
h AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)?', 1) AS q FROM every),
r AS (SELECT *, CASE WHEN host <> '' THEN host || path || q END AS address, CASE
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM r),
e AS (SELECT a.address AS a, b.address AS b FROM hop JOIN v a ON a.url = hop.src JOIN v b ON b.url = hop.dst WHERE a.address <> b.address),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT address AS a, address AS b FROM v WHERE address IS NOT NULL UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
g AS (SELECT a AS address, min(b) AS alias_group FROM reach GROUP BY a),
ruled AS (SELECT alias_group, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' END AS ruled FROM v JOIN g USING (address) GROUP BY alias_group),
p AS (SELECT page_id, host, path, rule, said, alias_group FROM u JOIN v USING (url) LEFT JOIN g USING (address)),
n AS (SELECT alias_group, count(*) AS group_pages FROM p WHERE alias_group IS NOT NULL GROUP BY alias_group)
SELECT page_id, host, path, rule, coalesce(said, ruled, 'allow') AS verdict, alias_group, group_pages FROM p LEFT JOIN n USING (alias_group) LEFT JOIN ruled USING (alias_group)"""


@query
def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


ORACLE_SQL["op7_vector_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY vec_id"""


@query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL["op10_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
c AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s HAVING len(s) > 0),
e AS (SELECT c, n, unnest(s) AS h FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.h = b.h AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT c AS a, c AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
g AS (SELECT a, min(b) AS g FROM r GROUP BY a),
k AS (SELECT doc_id, list_sort(s) AS s FROM s),
m AS (SELECT c.c, count(*) AS docs FROM c JOIN k ON c.s = k.s GROUP BY c.c),
o AS (SELECT m.c, m.docs - 1 + coalesce(sum(x.docs), 0) AS others FROM m LEFT JOIN p ON p.a = m.c LEFT JOIN m x ON x.c = p.b GROUP BY m.c, m.docs)
SELECT doc_id, len(k.s)::BIGINT AS n_shingles, coalesce(g.g, doc_id) AS component_id, coalesce(o.others, 0)::BIGINT AS n_links
FROM k LEFT JOIN c ON c.s = k.s LEFT JOIN g ON g.a = c.c LEFT JOIN o ON o.c = c.c"""


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.line_sections(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.attribute(docs, rule="majority").select("doc_id", "section", "n_chars", "n_tokens", "n_crossing")


@query
def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, net).select("doc_id", byte_cnn.held_out().alias("held_out"), "score", "predicted")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2("text", 256).alias("text_sha256"))


@query
def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return hidden_markov.language_model(table(spark, sf_dir, "documents").select("doc_id", "text"), learn)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("position")


ORACLE_SQL["op12_prefix_trie"] = prefix_trie.ORACLE_SQL


@query
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


ORACLE_SQL["op13_fill_middle"] = fill_middle.ORACLE_SQL
