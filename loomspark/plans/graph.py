"""Queries of the graph family. Edges: customer-orders (person-doc), orders-part (mention), supplier-nation
and nation-region (entity-entity), users' events (agent evidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import graph as G
from loomspark.registry import query, table

CANON_SQL = """canon AS (
SELECT 'person_doc' AS kind, 'person' AS src_kind, o_custkey AS src, 'doc' AS dst_kind, o_orderkey AS dst, 'ordered' AS predicate, 1.0::DOUBLE AS confidence FROM orders
UNION ALL SELECT 'mention', 'doc', l_orderkey, 'part', l_partkey, 'contains', round(1 - l_discount, 6) FROM lineitem
UNION ALL SELECT 'entity', 'supplier', s_suppkey, 'nation', s_nationkey, 'located in', 0.9::DOUBLE FROM supplier
UNION ALL SELECT 'entity', 'nation', n_nationkey, 'region', n_regionkey, 'part of', 1.0::DOUBLE FROM nation)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name, kind, src_kind, src, dst_kind, dst, predicate, confidence):
        return table(spark, sf_dir, name).select(
            F.lit(kind).alias("kind"), F.lit(src_kind).alias("src_kind"), F.col(src).cast("long").alias("src"), F.lit(dst_kind).alias("dst_kind"),
            F.col(dst).cast("long").alias("dst"), F.lit(predicate).alias("predicate"), confidence.alias("confidence"),
        )

    return G.canonical(
        of("orders", "person_doc", "person", "o_custkey", "doc", "o_orderkey", "ordered", F.lit(1.0)),
        of("lineitem", "mention", "doc", "l_orderkey", "part", "l_partkey", "contains", F.round(1 - F.col("l_discount"), 6)),
        of("supplier", "entity", "supplier", "s_suppkey", "nation", "s_nationkey", "located in", F.lit(0.9)),
        of("nation", "entity", "nation", "n_nationkey", "region", "n_regionkey", "part of", F.lit(1.0)),
    )


def seeds(spark: SparkSession, *nodes: tuple[str, int]) -> DataFrame:
    return spark.createDataFrame(list(nodes), "kind string, id long")


@query(f"WITH {CANON_SQL} SELECT kind, predicate, count(*) AS n, round(sum(confidence), 4) AS weight FROM canon GROUP BY ALL")
def canon_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("kind", "predicate").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("weight"))


@query(f"""WITH {CANON_SQL} SELECT kind, dst_kind AS other_kind, dst AS other, 'out' AS direction, confidence FROM canon WHERE src_kind = 'doc' AND src = 7
UNION ALL SELECT kind, src_kind, src, 'in', confidence FROM canon WHERE dst_kind = 'doc' AND dst = 7""")
def neighbors_1hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.directed(edges(spark, sf_dir), seeds(spark, ("doc", 7))).select("kind", "other_kind", "other", "direction", "confidence")


@query(f"""WITH RECURSIVE {CANON_SQL}, steps AS (SELECT src_kind AS a_kind, src AS a, dst_kind AS kind, dst AS id FROM canon UNION SELECT dst_kind, dst, src_kind, src FROM canon),
walk AS (SELECT 'person' AS kind, 11::BIGINT AS id, 0 AS hop UNION SELECT s.kind, s.id, hop + 1 FROM walk w JOIN steps s ON s.a_kind = w.kind AND s.a = w.id WHERE hop < 3)
SELECT kind, id, min(hop)::INT AS hop FROM walk GROUP BY ALL""")
def neighbors_khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hops(edges(spark, sf_dir), seeds(spark, ("person", 11)), 3)


@query(f"""WITH {CANON_SQL}, d AS (SELECT src AS root, dst_kind AS other_kind, dst AS other, predicate, confidence FROM canon WHERE src_kind = 'doc' AND src IN (1, 2, 3) AND confidence >= 0.95)
SELECT * FROM d""")
def related_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.directed(edges(spark, sf_dir).filter("confidence >= 0.95"), seeds(spark, ("doc", 1), ("doc", 2), ("doc", 3)), "out")
    return found.select("root", "other_kind", "other", "predicate", "confidence")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("entity_id"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS e FROM lineitem)
SELECT doc_id, count(*) AS shared FROM m WHERE doc_id <> 7 AND e IN (SELECT e FROM m WHERE doc_id = 7) GROUP BY doc_id""")
def shares_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sharing_entity(mentions(spark, sf_dir), 7)


@query("""SELECT l_orderkey AS doc_id, count(*) FILTER (l_suppkey = 1) AS n_a, count(*) FILTER (l_suppkey = 2) AS n_b FROM lineitem WHERE l_suppkey IN (1, 2)
GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2""")
def pairwise_shared_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("entity_id"))
    return G.shared_documents(found, 1, 2)


@query(f"""WITH {CANON_SQL}, s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')
SELECT kind, predicate, count(*) AS n FROM canon WHERE (src_kind = 'doc' AND src IN (FROM s)) OR (dst_kind = 'doc' AND dst IN (FROM s)) GROUP BY ALL""")
def context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    found = G.directed(edges(spark, sf_dir), some.select(F.lit("doc").alias("kind"), F.col("o_orderkey").alias("id")))
    return found.groupBy("kind", "predicate").agg(F.count("*").alias("n"))


@query(f"""WITH {CANON_SQL}, nodes AS (SELECT dst_kind AS kind, dst AS id FROM canon WHERE kind = 'entity' UNION SELECT src_kind, src FROM canon WHERE kind = 'entity'),
names AS (SELECT 'nation' AS kind, n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'region', r_regionkey, r_name FROM region)
SELECT n.kind, n.id, coalesce(name, n.id::VARCHAR) AS name FROM nodes n LEFT JOIN names m ON n.kind = m.kind AND n.id = m.id""")
def node_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = edges(spark, sf_dir).filter("kind = 'entity'")
    ends = F.explode(F.array(F.struct(F.col("src_kind").alias("kind"), F.col("src").alias("id")), F.struct(F.col("dst_kind").alias("kind"), F.col("dst").alias("id"))))
    nodes = some.select(ends.alias("n")).select("n.*").distinct()
    names = table(spark, sf_dir, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    names = names.unionByName(table(spark, sf_dir, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").cast("long").alias("id"), F.col("r_name").alias("name")))
    return G.with_names(nodes, names)


@query("""SELECT event_id, user_id, row_number() OVER w AS step, lag(event_id) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def trace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.trace(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", F.col("step").cast("long").alias("step"), "previous")
