"""Closed-form cases and properties of the memory-store operators."""

import datetime as dt
import math
import os
import random
import re
import subprocess
import sys
import uuid

import pytest
from loomspark.functions import numbers as N
from loomspark.functions import structured as S
from loomspark.functions import text as T
from loomspark.operators import analytics as A
from loomspark.operators import curation as C
from loomspark.operators import evidence as E
from loomspark.operators import extraction, graph, memory
from loomspark.operators import ranking as R
from loomspark.plans.curation import fake_extract
from loomspark.plans.ingestion import extract_entities
from loomspark.plans.session import Session
from loomspark.sources import exports, files
from loomspark.streaming import pipelines
from pyspark.sql import functions as F


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items()) or "x int"
    return spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema).select(column.alias("r")).first().r


def combined(spark, confidences, sources=None):
    sources = sources or [str(i) for i in range(len(confidences))]
    rows = [(1, "p", "o", s, c) for s, c in zip(sources, confidences, strict=True)]
    df = spark.createDataFrame(rows, "subject int, predicate string, object string, source string, confidence double")
    found = E.compounded(E.strongest_per_source(df)).collect()
    return found[0].confidence if found else 0.0


@pytest.mark.parametrize(
    ("confidences", "want"),
    [([], 0), ([0.0, 0.0], 0), ([0.97], 0.97), ([0.9, 0.8], 0.932), ([0.9, 0.9], 0.936), ([0.9] * 6, 0.95), ([0.97, 0.5], 0.97), ([1.7], 1), ([-3.0], 0), ([math.nan, 0.8], 0.8), ([0.8, 0.7], 0.856)],
)
def test_noisy_or(spark, confidences, want):
    assert combined(spark, confidences) == pytest.approx(want)


def test_noisy_or_properties(spark):
    rng = random.Random(2)
    for _ in range(5):
        c = [round(rng.random(), 3) for _ in range(rng.randint(1, 6))]
        whole = combined(spark, c)
        assert combined(spark, c[::-1]) == pytest.approx(whole)
        assert max(c) - 1e-6 <= whole <= max(0.95, max(c)) + 1e-6
        assert combined(spark, [*c, 0.1]) >= whole - 1e-6
    assert combined(spark, [0.6, 0.9, 0.7], ["a", "a", "b"]) == combined(spark, [0.9, 0.7])
    assert combined(spark, [0.8, 0.9, 0.7], [None] * 3) == 0.9


@pytest.mark.parametrize(("old", "new", "want"), [(0.9, 1.0, 0.54), (0.8, 0.7, 0.576), (0.9, 0.1, 0.864), (0.5, math.nan, 0.5), (-5.0, 2.0, 0.0)])
def test_penalty(spark, old, new, want):
    assert one(spark, N.weakened(F.col("a"), F.col("b")), a=("double", old), b=("double", new)) == pytest.approx(want)


def sightings(spark, rows):
    full = [(i, s, p, o, src, c, t) for i, (s, p, o, src, c, t) in enumerate(rows)]
    return spark.createDataFrame(full, "event_id int, subject string, predicate string, object string, source string, confidence double, observed_at int")


def test_contradiction_lifecycle(spark):
    seen = sightings(spark, [("ann", "works at", "a", "d1", 0.8, 1), ("ann", "works at", "a", "d2", 0.7, 2), ("ann", "works at", "b", "d3", 0.9, 3)])
    old, new = E.intervals(seen).orderBy("interval").collect()
    assert (old.confidence, old.valid_to, new.confidence, new.valid_to) == (pytest.approx(0.54784), 3, pytest.approx(0.9), None)
    claims = {r.object: (r.state, r.superseded_by) for r in E.ledger(E.intervals(seen)).collect()}
    assert claims == {"a": ("superseded", 2), "b": ("active", None)}
    back = E.intervals(seen.unionByName(sightings(spark, [("ann", "works at", "a", "d4", 0.5, 9)]).withColumn("event_id", F.lit(9)))).orderBy("interval").collect()
    assert [r.object for r in back] == ["a", "b", "a"] and back[2].confidence > 0.85


def test_intervals_match_a_sequential_walk(spark):
    rng = random.Random(9)
    rows = [(f"s{rng.randrange(12)}", "p", f"o{rng.randrange(3)}", f"d{rng.randrange(5)}", round(rng.random(), 2), t) for t in range(150)]

    def strength(evidence):
        c = sorted((x for x in evidence.values() if x > 0), reverse=True)
        return min(max(0.95, c[0]), 1 - (1 - c[0]) * math.prod(1 - 0.4 * x for x in c[1:])) if c else 0.0

    open_, proof, want = {}, {}, []
    for s, _, o, d, c, t in rows:
        if s not in open_ or open_[s]["o"] != o:
            if s in open_:
                was = open_[s]
                want.append((s, was["o"], was["from"], t, round(strength(was["all"]) * (1 - 0.4 * c), 6)))
                for k, v in was["own"].items():
                    proof.setdefault((s, was["o"]), {})[k] = max(v, proof.get((s, was["o"]), {}).get(k, 0))
            open_[s] = {"o": o, "from": t, "own": {}, "all": dict(proof.get((s, o), {}))}
        now = open_[s]
        if d not in now["own"]:
            now["own"][d] = c
            now["all"][d] = max(c, now["all"].get(d, 0))
    want += [(s, w["o"], w["from"], None, round(strength(w["all"]), 6)) for s, w in open_.items()]
    got = [(r.subject, r.object, r.valid_from, r.valid_to, r.confidence) for r in E.intervals(sightings(spark, rows)).collect()]
    assert sorted(got, key=str) == [(*w[:4], pytest.approx(w[4], abs=2e-6)) for w in sorted(want, key=str)]


def test_trend(spark):
    seen = sightings(spark, [("a", "p", "o", "d1", 0.8, 1), ("a", "p", "o", "d1", 0.9, 2), ("a", "p", "o", "d2", 0.7, 3), ("b", "p", "o", "d1", 0.7, 3)])
    assert [r.trend for r in E.trend(seen).collect()] == ["0.800 -> 0.856"]


def test_min_max_blend_recency_and_budget(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([4, 2, 0])], "doc_id int, v double")
    assert [r.s for r in R.min_max(df, "v", "s").orderBy("doc_id").collect()] == [1, 0.5, 0]
    assert {r.s for r in R.min_max(df.withColumn("v", F.lit(3.0)), "v", "s").collect()} == {0}
    aged = spark.createDataFrame([(1, 0.9, 1), (2, 0.7, 2), (3, 0.5, 3)], "doc_id int, score double, created_at int")
    assert [r.reranked for r in R.recency(aged).orderBy("doc_id").collect()] == [pytest.approx(x) for x in (0.73, 0.69, 0.65)]
    hits = spark.createDataFrame([(r, "x" * 40) for r in (1, 2, 3)], "rank int, text string")
    assert [r["rank"] for r in R.token_budget(hits, 20).collect()] == [1, 2]
    cut = R.token_budget(hits, 6).collect()
    assert [(r["rank"], r.tokens, len(r.text), r.truncated) for r in cut] == [(1, 6, 24, True)]
    assert R.token_budget(hits, 0).count() == 3 and R.token_budget(hits, -1).count() == 3


def test_bm25_counts_repeated_query_terms(spark):
    df = spark.createDataFrame([(1, "cat dog"), (2, "dog dog bird"), (3, "")], "doc_id int, text string")
    single = {r.doc_id: r.bm25 for r in R.bm25(df, "dog").collect()}
    double = {r.doc_id: r.bm25 for r in R.bm25(df, "dog dog").collect()}
    assert all(double[i] == pytest.approx(2 * single[i], abs=2e-6) for i in single) and single[3] == 0 and single[2] > single[1]
    assert {r.bm25 for r in R.bm25(df, "").collect()} == {0}


def test_names(spark):
    for raw, want in (("ASSIGNED_TO", "assigned to"), ("part-of", "part of"), ("x" * 60, None), ("we!rd$chars", None), ("", None)):
        assert one(spark, T.type_name(F.col("a")), a=("string", raw)) == want
    assert one(spark, T.predicate_name(F.col("a")), a=("string", " Currently now Works at ")) == "works at"
    assert one(spark, T.capitalised(F.col("a")), a=("string", "Acme met Bob and Acme in Orgz-One, Al")) == ["Acme", "Bob", "Orgz-One"]
    assert one(spark, T.preview(F.col("a")), a=("string", "y" * 130)) == "y" * 117 + "..."
    assert one(spark, T.sanitize(F.col("a")), a=("string", "\n a[[ref:1]] b [Memory:id:2]c<!-- d\n -->    e\n\n\n\nf ")) == "a b c  e\n\nf"
    kept = "keep [note: call Bob] and [TODO: fix] [[Topic: x]] [ref:] [source] [1]"
    assert one(spark, T.sanitize(F.col("a")), a=("string", kept)) == kept
    once = one(spark, T.sanitize(F.col("a")), a=("string", "x [[CHUNK:a b]] [hyobject:1\n2] [[mcp:1] y [system:z]] end"))
    assert once == "x   [ y ] end" or once == one(spark, T.sanitize(F.col("a")), a=("string", once))
    assert [len(x) for x in one(spark, T.fixed_windows(F.col("a")), a=("string", "z" * 1700))] == [800, 800, 300]
    assert one(spark, T.fixed_windows(F.col("a")), a=("string", "")) == [""]
    for value, band in ((0.8, "high"), (0.5, "medium"), (0.49, "low"), (math.nan, None), (None, None)):
        assert one(spark, T.confidence_band(F.col("a")), a=("double", value)) == band


def test_extraction_over_all_documents(spark, tmp_path):
    texts = ["Orgzilla hired Bob", "Éric kennt Straße und Zoë-Xyz", "éFoo Bar-é Baz_É Ähre Quux--- No", "日本Tokyo 東京", "Ärger " + "Abc Def " * 9 + "Late", "", None]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    word = re.compile(r"\b[A-Z][a-zA-Z0-9_-]{2,}\b", re.ASCII)
    want = {i: list(dict.fromkeys(word.findall(t)[:8])) for i, t in rows if t is not None}
    assert {r.doc_id: r.names for r in fake_extract(spark, str(tmp_path)).collect()} == {i: sorted(x) for i, x in want.items()}
    got = sorted((r.doc_id, r.name) for r in extract_entities(spark, str(tmp_path)).collect())
    assert got == sorted((i, n) for i, x in want.items() for n in x)


def test_extraction_normal_form(spark):
    found = [[("  Acme Corp  ", None, [" a ", " ", "b"], 1.5), (" ", "x", [], 0.5), ("Bob", " Person ", None, math.nan)]]
    df = spark.createDataFrame([(found[0],)], f"e {extraction.ENTITY}")
    rows = df.select(extraction.normal_entities(F.col("e")).alias("e")).first().e
    assert [tuple(r) for r in rows] == [("Acme Corp", "concept", ["a", "b"], 1.0), ("Bob", "person", None, 0.5)]
    chunk = spark.createDataFrame([(1, "Orgzilla hired Bob")], "doc_id int, text string")
    assert {(r.name, r.kind, r.confidence) for r in extraction.entities(chunk).collect()} == {("Orgzilla", "organization", 0.9), ("Bob", "concept", 0.55)}


def test_proposals_and_promotion(spark):
    rows = [("Product", "d1", 0.7), ("product", "d1", 0.95), ("thing", "d1", 0.6), ("other", "d1", 0.59), ("known_type", "d2", 0.9)]
    catalog = spark.createDataFrame([("Known Type", 4)], "name string, type_id int")
    found = C.schema_proposals(spark.createDataFrame(rows, "name string, source string, confidence double"), catalog)
    assert {(r.name, r.seen_count, r.confidence) for r in found.collect()} == {("product", 1, 0.95), ("thing", 1, 0.6)}
    ready = spark.createDataFrame([("a", 3, 0.8), ("known type", 5, 0.9), ("b", 2, 0.9), ("c", 3, 0.79), ("d", 3, 0.9)], "name string, seen_count int, confidence double")
    assert {(r.name, r.type_id, r.reused) for r in C.promote_types(ready, catalog).collect()} == {("a", 5, False), ("d", 6, False), ("known type", 4, True)}
    assert C.promote_types(ready, catalog, strict=True).count() == 0


def test_queue(spark):
    rows = [(1, "processing", 1, 0), (2, "processing", 3, 0), (3, "processing", 1, 58), (4, "pending", 3, 0), (5, "pending", 0, 9), (6, "pending", 0, 5)]
    df = spark.createDataFrame(rows, "chunk_id int, status string, attempts int, m int")
    df = df.withColumn("updated_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m, 0)"))
    after = {r.chunk_id: r.status for r in C.reap(df, F.expr("timestamp_ntz'2024-01-01 01:00:00'")).collect()}
    assert after == {1: "pending", 2: "failed", 3: "processing", 4: "pending", 5: "pending", 6: "pending"}
    assert [r.chunk_id for r in C.claim(df, 2).collect()] == [6, 5]


def test_session_isolation(spark):
    rows = [(1, "w1", 1, "a"), (2, "w1", 2, "b"), (3, "w2", 2, "a"), (4, "w1", None, "b"), (5, "w1", 4, None), (6, "w1", 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id int, workspace string, sharing int, agent string")
    tenants = spark.createDataFrame([("w1", "t1"), ("w2", "t2")], "workspace string, tenant string")
    ids = lambda **k: {r.doc_id for r in Session({"d": docs}, tenants=tenants, **k).table("d").collect()}
    assert ids(workspace="w1", actor="b") == {2, 4, 5, 6} and ids(workspace="w1", actor="a") == {1, 2, 4, 5, 6}
    assert ids(workspace="w1", role="service") == {1, 2, 4, 5, 6} and ids(workspace="w1", actor="a", role="llm") == {2, 5}
    assert ids(workspace="w1", tenant="t2") == set()
    with pytest.raises(PermissionError):
        ids()


def test_entity_resolution(spark):
    names = spark.createDataFrame([("p", n) for n in ("Ann", "Ann Lee", "Dr Ann Lee", "Lee", "Bob")] + [("q", "Ann")], "kind string, name string")
    got = {(r.kind, r.name): r.canonical for r in C.resolve_names(names).collect()}
    assert got == {("p", "ann"): "dr ann lee", ("p", "ann lee"): "dr ann lee", ("p", "dr ann lee"): "dr ann lee", ("p", "lee"): "dr ann lee", ("p", "bob"): "bob", ("q", "ann"): "ann"}


def test_names_nested_deeply(spark):
    long = [" ".join(f"w{i}" for i in range(n)) for n in range(1, 30)]
    got = C.resolve_names(spark.createDataFrame([("p", n) for n in long], "kind string, name string")).collect()
    assert {r.canonical for r in got} == {long[-1]} and len(got) == 29


def test_memory_tools(spark):
    from loomspark.operators import memory as M

    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", 2)], "id int, x string, v int")
    new = spark.createDataFrame([(1, "A", 2), (2, "B", 4), (3, "C", 2), (4, "D", None)], "id int, x string, v int")
    assert {r.id: r.x for r in M.keep_latest(old, new, ["id"], "v").collect()} == {1: "A", 2: "b", 3: "C", 4: "D"}
    writes = spark.createDataFrame([("fact", None, None), ("fact", True, False), ("ingest", False, True), ("annotate", True, True), (None, True, True)], "kind string, superseding boolean, high_risk boolean")
    assert [r.gate for r in M.gated(writes, "silent").collect()] == [False, True, True, False, False]
    assert [r.gate for r in M.gated(writes, "audit").collect()] == [True, True, True, False, False]
    jobs = spark.createDataFrame([(1, ["x", "ok"]), (2, ["x"]), (3, ["x"] * 3), (4, ["x", "x", "x", "ok"]), (5, [])], "id int, outcomes array<string>")
    assert [(r.tried, r.next) for r in M.after_failures(jobs).collect()] == [(2, "done"), (1, "retry"), (3, "quarantined"), (3, "quarantined"), (0, "retry")]
    ids = spark.createDataFrame([(11,), (12,), (2,)], "id int")
    assert [tuple(M.by_id_prefix(ids, "id", p).first()) for p in ("2", "1", "9")] == [("2", "found"), (None, "ambiguous"), (None, "unknown")]
    names = spark.createDataFrame([("Ann Lee", ["AL"]), ("Bob", ["ann"]), (None, ["ann"]), ("Cy", None)], "name string, aliases array<string>")
    assert M.named_like(names, "ann").count() == 3 and M.named_like(names, "AL").count() == 1
    seen = spark.createDataFrame([("Works_For",), ("currently located in",), ("knows",), (None,)], "predicate string")
    one_, rest = M.functional_only(seen)
    assert (one_.count(), rest.count()) == (2, 2) and M.functional_only(seen, ("knows",))[0].count() == 3
    assert C.ingest(spark.createDataFrame([(1, "w", "h"), (1, "w", "h"), (2, "w", "h"), (3, None, "h")], "doc_id int, workspace string, sha256 string")).filter("deduped").count() == 2


def test_endpoint_recovery(spark):
    own = spark.createDataFrame([(1, "Acme Labs", ["Acme"], 0.9), (2, "Solo", None, 0.9)], "doc_id int, name string, aliases array<string>, confidence double")
    said = [(1, 0, "acme", "Ferry Ltd "), (1, 1, "FERRY LTD", "Zed"), (1, 2, "q", None), (3, 0, "New", "new"), (2, 0, "solo", "SOLO")]
    relations = spark.createDataFrame(said, "doc_id int, position int, subject string, object string")
    asked = extraction.missing_endpoints(own, relations)
    assert sorted((r.doc_id, r.key, r.name) for r in asked.collect()) == [(1, "ferry ltd", "Ferry Ltd"), (1, "zed", "Zed"), (3, "new", "New")]
    assert [r.name for r in extraction.missing_endpoints(own, relations, most=1).filter("doc_id = 1").collect()] == ["Ferry Ltd"]
    found = [(1, "ferry ltd", [], 0.4), (1, "Ferry Ltd", [], 0.8), (1, "Invented", [], 1.0), (1, "ACME LABS", [], 1.0)]
    found = spark.createDataFrame(found, own.schema)
    rows = extraction.with_recovered(own, found, asked).select("doc_id", "name", "recovered").collect()
    assert sorted(map(tuple, rows)) == [(1, "Acme Labs", False), (1, "Ferry Ltd", True), (2, "Solo", False)]
    none = extraction.missing_endpoints(own.limit(0), relations.limit(0))
    assert none.count() == 0 and extraction.with_recovered(own, found, none).count() == 2


def test_purge_reaches_every_depth(spark):
    tables = {
        "docs": spark.createDataFrame([(1,), (2,), (None,)], "doc int"),
        "chunks": spark.createDataFrame([(10, 1), (20, 2), (30, None)], "chunk int, doc int"),
        "proofs": spark.createDataFrame([(10, 2), (20, 2), (20, 1), (None, None)], "chunk int, doc int"),
        "apart": spark.createDataFrame([(1,)], "doc int"),
    }
    references = {"chunks": {"doc": "docs"}, "proofs": {"chunk": "chunks", "doc": "docs"}}
    keys = {"docs": "doc", "chunks": "chunk"}
    purge = lambda ids: memory.purged(tables, {"docs": spark.createDataFrame(ids, "doc int")}, references, keys)
    left = {name: [tuple(r) for r in rows.collect()] for name, rows in purge([(1,), (1,), (9,)]).items()}
    assert sorted(left["docs"], key=str) == [(2,), (None,)] and sorted(left["chunks"]) == [(20, 2), (30, None)]
    assert sorted(left["proofs"], key=str) == [(20, 2), (None, None)] and left["apart"] == [(1,)]
    assert all(rows.count() == tables[name].count() for name, rows in purge([]).items())


def test_change_log_and_review(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (3, "c", 3)], "id int, x string, y int")
    got = {tuple(r) for r in C.changes(old, new, "id", ["x", "y"]).collect()}
    assert got == {(1, "update", "y", "1", None), (2, "delete", "x", "b", None), (2, "delete", "y", "2", None), (3, "insert", "x", None, "c"), (3, "insert", "y", None, "3")}
    proposals = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "approved")], "proposal_id int, state string")
    decisions = spark.createDataFrame([(1, "approve", 1), (1, "reject", 2), (3, "reject", 1)], "proposal_id int, decision string, decided_at int")
    assert {r.proposal_id: r.state for r in C.review(proposals, decisions).collect()} == {1: "rejected", 2: "pending", 3: "approved"}


def test_inserts_of_approved_reviews(spark):
    have = spark.createDataFrame([(5, "Acme", "org"), (3, "ACME", "org"), (7, "Acme", "place")], "entity_id int, name string, kind string")
    wanted = [(1, "acme", "org", "approved"), (2, "Beta", "org", "approved"), (3, "BETA", "org", "approved"), (4, "Acme", None, "approved"), (5, "acme", "org", "rejected")]
    wanted = spark.createDataFrame(wanted, "proposal_id int, name string, kind string, state string")
    got = {r.proposal_id: r for r in C.approved_entities(wanted, have).collect()}
    assert set(got) == {1, 2, 3, 4} and (got[1].entity_id, got[1].made) == ("3", False)
    assert got[2].made and got[2].entity_id == got[3].entity_id != got[4].entity_id and got[4].made
    edges = spark.createDataFrame([(3, "p", 5), (3, "p", 5)], "subject int, predicate string, object int")
    said = [(1, 3, "p", 5), (2, 5, "p", 3), (3, 5, "p", 3), (4, 3, "p", 9), (5, None, "p", 3)]
    said = spark.createDataFrame([(*r, "approved") for r in said] + [(6, 3, "q", 5, "pending")], "proposal_id int, subject int, predicate string, object int, state string")
    got = {r.proposal_id: r.outcome for r in C.approved_edges(said, have, edges).collect()}
    assert got == {1: "kept", 2: "made", 3: "superfluous", 4: "blocked", 5: "blocked"}
    assert C.approved_edges(said.limit(0), have, edges).count() == 0


def test_hops(spark):
    edges = spark.createDataFrame([("k", "n", a, "n", b, "p", 1.0) for a, b in ((1, 2), (2, 3), (3, 1), (3, 4), (9, 8))], ", ".join(f"{c} {'long' if c in ('src', 'dst') else 'double' if c == 'confidence' else 'string'}" for c in graph.EDGE_COLUMNS))
    got = {r.id: r.hop for r in graph.hops(edges, spark.createDataFrame([("n", 1)], "kind string, id long"), 3).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_json_repair_and_chunks(spark):
    assert S.close_json('{"a": [{"b": "x]"}, {"c": ') == '{"a": [{"b": "x]"}]}'
    assert S.close_json('{"a') == '{"a' and S.close_json(None) is None and S.close_json('{"a": 1}') == '{"a": 1}'

    chunks = lambda t: one(spark, S.paragraph_chunks(F.col("a")), a=("string", t))
    assert chunks("a" * 1000) == ["a" * 1000] and chunks("") == [""]
    # a paragraph stays whole, whatever its length; the next chunk begins with the end of the one before
    assert chunks("x" * 1500 + "\n\n" + "y" * 20) == ["x" * 1500, "x" * 150 + "\n\n" + "y" * 20]
    assert chunks("a" * 600 + "\n\n\n\n" + "b" * 600) == ["a" * 600, "a" * 150 + "\n\n" + "b" * 600]
    rng = random.Random(1)
    for _ in range(6):
        paragraphs = [f"p{i} " + "".join(rng.choice("abc ") for _ in range(rng.randint(1, 700))) + "." for i in range(rng.randint(2, 9))]
        got = chunks("\n\n".join(paragraphs))
        assert all(any(p.strip() in c for c in got) for p in paragraphs)  # none is lost or cut
        assert all(len(c) <= 1000 + 152 or max(map(len, paragraphs)) > 500 for c in got)
        assert all(b.startswith(a[-150:].lstrip()[:20]) or a[-150:].strip()[:20] in b[:200] for a, b in zip(got, got[1:], strict=False))
    space = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    assert one(spark, S.name_uuid(str(space), F.col("a")), a=("string", "mé")) == str(uuid.uuid5(space, "mé"))


def test_exports(spark, tmp_path):
    tree = """[{"id": "c1", "title": "T", "current_node": "n3", "mapping": {"r": {"id": "r", "parent": null}, "n1": {"id": "n1", "parent": "r", "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}},
      "n2": {"id": "n2", "parent": "n1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["no"]}}}, "n3": {"id": "n3", "parent": "n1", "message": {"author": {"role": "assistant"}, "content": {"parts": ["yes", " "]}}}}}]"""
    (tmp_path / "tree.json").write_text(tree)
    nodes, heads = exports.read_tree_export(spark, str(tmp_path / "tree.json"))
    branch = exports.active_branch(nodes, heads.select("conv_id", "node")).join(nodes, ["conv_id", "node"]).orderBy("position")
    assert [(r.node, r.text) for r in branch.collect()] == [("r", None), ("n1", "hi"), ("n3", "yes")]
    (tmp_path / "list.json").write_text('[{"uuid": "u", "chat_messages": [{"sender": "human", "text": "q"}, {"sender": "assistant", "text": "", "content": [{"type": "text", "text": "a"}]}, {"sender": "human", "text": " "}]}]')
    turns = exports.read_list_export(spark, str(tmp_path / "list.json"))
    assert exports.render(turns).first().text == "User: q\n\nAssistant: a"
    for names, want in ((["chat.html"], "tree"), (["users.json"], "list"), (["chat.html", "users.json"], None), (["conversations.json"], "tree"), (["x"], None)):
        assert one(spark, exports.kind_of(F.col("a")), a=("array<string>", names)) == want
    for raw, year in (("1700000000", 2023), ("2024-02-03T04:05:06Z", 2024), ("12", None), ("nope", None)):
        got = one(spark, F.year(exports.timestamp(F.col("a"))), a=("string", raw))
        assert got == year


def test_folder_source_and_stream(spark, tmp_path):
    root = tmp_path / "in"
    for name, data in {"a.md": b"hello", "b.bin": b"x", "c.txt": b"nul\0", "d.txt": b"  \n", "node_modules/e.md": b"skip", "sub/Makefile": b"all:", "f.txt": b""}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "g.txt").write_bytes(b"a" * 1_000_001)
    assert {r.name for r in files.read_folder(spark, str(root)).collect()} == {"a.md", "Makefile"}
    pipelines.append_batches(files.watch_folder(spark, str(root)), f"{tmp_path}/offsets", f"{tmp_path}/out")
    assert {r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a.md", "Makefile"}
    for name, want in (("x.PDF", "application/pdf"), ("y", "application/octet-stream"), ("a.b.csv", "text/csv")):
        assert one(spark, files.mime_type(F.col("a")), a=("string", name)) == want
    for url, want in (("github:a/b", "a/b"), ("https://github.com/a/b.git", "a/b"), ("ftp://x", None)):
        assert one(spark, files.repository_slug(F.col("a")), a=("string", url)) == want


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"s{rng.randrange(4)}", "p", f"o{rng.randrange(2)}", f"d{rng.randrange(4)}", round(rng.random(), 2), t) for t in range(60)]
    seen = sightings(spark, rows)
    for k in range(3):
        seen.filter(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(seen.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    pipelines.rescore_stream(stream, f"{tmp_path}/offsets", f"{tmp_path}/evidence", f"{tmp_path}/scores")
    got = {tuple(r) for r in pipelines.current_scores(spark.read.parquet(f"{tmp_path}/scores")).collect()}
    assert got == {tuple(r) for r in E.compounded(E.strongest_per_source(seen)).collect()}


def test_milestones_and_tiers(spark):
    df = spark.createDataFrame([(n,) for n in (9, 10, 25, 26, 100, 101, 250, 300, 500)], "n long")
    rows = {r.n: (r.m, r.t) for r in df.select("n", A.milestone(F.col("n")).alias("m"), A.attribution_tier(F.col("n")).alias("t")).collect()}
    assert {n for n, (m, _) in rows.items() if m} == {10, 100, 250, 500}
    assert (rows[25][1], rows[26][1], rows[101][1]) == ("full", "conditional", "silent")


def test_entry_points_work_without_the_optional_parts(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.modules['loomspark.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e;"
        "q = e.queries(); assert 'hybrid_search' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


def against_sql(spark, folder, name, events):
    """Rows of a query over ``events`` that its SQL does not have, and the other way round."""
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet/*.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = {tuple(r) for r in cursor.fetchall()}
    got = {tuple(r) for r in entry.queries()[name](spark, str(folder)).select(*columns).collect()}
    return got - want, want - got


def test_trend_rounds_ties_as_sql(spark, tmp_path):
    # a first confidence of four digits that end in 5, then one of 0 on a later day: both steps are ties
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2)]
    events = [(2 * i + j, days[j], i, "view", (i / 10 + 0.05) * (1 - j)) for i in range(1000) for j in (0, 1)]
    assert against_sql(spark, tmp_path, "confidence_trend", events) == (set(), set())


def test_intervals_round_ties_as_sql(spark, tmp_path):
    # two sources of four digits whose compounded confidence has nine, the last three of them 500
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2)]
    pairs = [(a, q) for a in range(1, 10000) for q in range(1, 10001 - a, 50) if a * (25000 - q) % 250 == 125][::4]
    events = [(2 * i + j, days[j], i, "view", c / 100) for i, (a, q) in enumerate(pairs) for j, c in enumerate((10000 - a, q))]
    assert len(pairs) > 500 and against_sql(spark, tmp_path, "contradiction_intervals", events) == (set(), set())


def test_intervals_without_evidence_have_no_confidence(spark):
    seen = sightings(spark, [("ann", "works at", "a", "d1", 0.0, 1), ("ann", "works at", "b", "d2", 0.5, 2)])
    assert [r.confidence for r in E.intervals(seen).orderBy("interval").collect()] == [0.0, 0.5]
