"""Neighbours, the context pack, provenance, review and evaluation on small fixtures with nulls and repeats."""

import datetime as dt
import json

import pytest
from loomspark.operators import analytics as A
from loomspark.operators import curation as C
from loomspark.operators import graph as G
from loomspark.operators import neighbors as N
from loomspark.operators import pack as P
from loomspark.operators import provenance as W
from loomspark.operators import ranking as R
from loomspark.plans.session import Session
from loomspark.sources import exports
from loomspark.streaming import pipelines
from pyspark.sql import functions as F


def memory(spark):
    make = spark.createDataFrame
    return N.Memory(
        make([("d1", "a1", 2, 1), ("d2", "a2", 1, 2), ("d3", "a1", None, 3), ("d4", "a1", 1, 4)], "doc_id string, agent string, sharing int, created_at int"),
        make([(1, "d1", "d2", 7, 1, 0.5, 1), (2, "d3", "d1", 8, 5, 0.1, 1), (3, "d1", "d1", 7, 1, 0.9, 1)], "edge_id long, doc1 string, doc2 string, relation_type int, priority int, confidence double, created_at int"),
        make([(4, "p1", "d1", 7, 1.0, 1, None), (5, "p1", "d1", 7, 1.0, 2, 50), (6, "p2", "d1", 8, 1.0, 3, 200)], "edge_id long, person string, doc string, relation_type int, confidence double, created_at int, valid_to int"),
        make([(7, "e1", "d1", 0.9, 1), (8, "e1", "d2", 0.8, 2)], "edge_id long, entity string, doc string, confidence double, created_at int"),
        make([(9, "e1", "e2", "knows", 0.7, 1, None), (10, "e2", "e1", "knew", 0.7, 2, 10)], "edge_id long, entity1 string, entity2 string, predicate string, confidence double, created_at int, valid_to int"),
        make([(11, "p1", "p2", 9, 0.6, 1, None), (12, "p1", "p1", 9, 0.6, 1, 101)], "edge_id long, person1 string, person2 string, relation_type int, confidence double, created_at int, end_date int"),
        make([("m1", "agent_memory", "a1", "d1", "saved_memory", 1.0, 1), ("m2", "agent_agent", "a2", "a1", "recalled", 1.0, 2)], "edge_id string, kind string, source string, target string, predicate string, confidence double, created_at int"),
    )


def test_neighbors(spark):
    m = memory(spark)
    roots = spark.createDataFrame([("doc", "d1"), ("doc", "d1"), ("entity", "e1"), ("agent", "a1"), ("person", "p1"), ("doc", "none")], "kind string, id string")
    found = lambda **k: {(r.branch, r.root, r.edge_id, r.to_id) for r in N.neighbors(m, roots, F.lit(100), k.pop("actor", "a2"), **k).collect()}
    assert found() == {
        ("doc_doc", "d1", "1", "d2"), ("doc_doc", "d1", "2", "d1"), ("doc_doc", "d1", "3", "d1"), ("doc_person", "d1", "4", "p1"), ("doc_person", "d1", "6", "p2"),
        ("doc_entity", "d1", "7", "e1"), ("entity_entity", "e1", "9", "e2"), ("entity_doc", "e1", "7", "d1"), ("entity_doc", "e1", "8", "d2"),
        ("agent_doc", "a1", "d1", "d1"), ("agent_doc", "a1", "d3", "d3"), ("agent_memory", "a1", "m1", "d1"), ("agent_agent", "a1", "m2", "a1"),
        ("person_doc", "p1", "4", "d1"), ("person_person", "p1", "11", "p2"), ("person_person", "p1", "12", "p1"),
    }
    other = found(actor="a1")
    assert ("entity_doc", "e1", "8", "d2") not in other and ("agent_doc", "a1", "d4", "d4") in other
    first = found(limit=1)
    assert ("doc_doc", "d1", "2", "d1") in first and ("doc_person", "d1", "6", "p2") in first and ("doc_doc", "d1", "3", "d1") not in first
    typed = {e for e in found(relation_types=[8]) if e[0] in ("doc_doc", "doc_person", "person_doc", "person_person")}
    assert typed == {("doc_doc", "d1", "2", "d1"), ("doc_person", "d1", "6", "p2")}
    names = spark.createDataFrame([("doc", "d1", "First"), ("doc", "e2", "Doc E2"), ("entity", "e2", "Entity E2"), ("person", "a1", "Nobody")], "kind string, id string, name string")
    named = {(r.kind, r.id): r.name for r in N.nodes(N.neighbors(m, roots, F.lit(100), "a2"), roots, names).collect()}
    assert named[("doc", "d1")] == "First" and named[("entity", "e2")] == "Entity E2" and named[("agent", "a1")] == "agent a1" and named[("person", "p2")] is None and ("doc", "none") in named
    assert spark.createDataFrame([("person", "e2")], "kind string, id string").transform(lambda r: N.nodes(N.neighbors(m, r, F.lit(0), "x"), r, names)).first().name == "Entity E2"


def test_neighbors_that_share_an_edge_id(spark):
    m, answers = memory(spark), []
    roots = spark.createDataFrame([("doc", "d1")], "kind string, id string")
    rows = [(7, e, "d1", c, 1) for e, c in (("e2", 0.9), ("e1", 0.7), ("e3", 0.8), ("e1", 0.95))]
    for given in (rows, rows[::-1]):
        m.mentions = spark.createDataFrame(given, "edge_id long, entity string, doc string, confidence double, created_at int").coalesce(1)
        answers.append([(r.to_id, r.confidence) for r in N.neighbors(m, roots, F.lit(100), "a2", 1).filter("branch = 'doc_entity'").collect()])
    assert answers == [[("e1", 0.95)], [("e1", 0.95)]]


def test_pack_and_envelope(spark):
    hits = spark.createDataFrame([(1, "x" * 40, "t1", 0.9, 5, 1), (2, "y" * 40, "t2", 0.6, 6, 2), (3, "z" * 4000, "t1", 0.1, 7, 3)], "doc_id long, text string, type string, score double, created_at int, rank int")
    entities = spark.createDataFrame([(i, f"Ring {i:02}", None) for i in range(15)] + [(90, "Other", ["ring"]), (91, "None", ["RING"]), (92, None, None)], "entity_id long, name string, aliases array<string>")
    people = spark.createDataFrame([(1, "Ann", "ann@ring.org"), (2, "Bob", None), (3, None, None)], "person_id long, name string, email string")
    notes = spark.createDataFrame([(i, "me", f"the RING {i}", i) for i in range(8)] + [(20, "you", "ring", 99)], "note_id long, agent string, content string, created_at int")
    edges = spark.createDataFrame([("k", "doc", 1, "entity", 5, "has", 0.4), ("k", "person", 1, "doc", 1, "wrote", 0.8), ("k", "doc", 3, "doc", 4, "no", 1.0)], "kind string, src_kind string, src long, dst_kind string, dst long, predicate string, confidence double")
    rows = P.pack(hits, entities, people, notes, edges, "ring", "me", 30, "ambient").collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.section, r["rank"])):
        by.setdefault(r.section, []).append(r)
    ids = lambda s: [r.id for r in by[s]]
    assert ids("document") == ["1", "2"] and len(ids("entity")) == 10 and ids("entity")[0] == "90" and ids("person") == ["1"] and ids("note") == ["7", "6", "5", "4", "3"]
    assert ids("relation") == ["person:1", "doc:1"] and json.loads(by["entity"][0].detail) == {"aliases": ["ring"]}
    assert json.loads(by["metadata"][0].detail) == {"hits": 2, "documents": 2, "by_type": "t1:1,t2:1"}
    assert json.loads(by["envelope"][0].detail) == {"mode": "ambient", "fact_count": 2, "confidence_band": "medium", "source_type_count": 2, "source_types": {"t1": 1, "t2": 1}}
    assert by["envelope"][0].name == '2 facts used. Ask "why" to see sources.'
    none = P.envelope(hits.limit(0), "audit").first()
    assert (none.fact_count, none.confidence_band, none.heartbeat, none.source_types) == (0, None, None, {})
    assert P.envelope(hits.limit(1), "audit").first().heartbeat.startswith("1 fact used") and P.envelope(hits, "silent").first().heartbeat is None
    with pytest.raises(ValueError):
        P.envelope(hits, "loud")


def test_provenance(spark):
    spans = spark.createDataFrame([("a", "b", "p", 0.5, 1, None), ("b", "a", "q", 0.4, 1, 2), ("a", "a", "self", 0.1, 1, None), ("a", "c", "r", 0.1, 1, None)], "subject string, object string, predicate string, confidence double, valid_from int, valid_to int")
    mentions = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("a", 2), ("b", 3)], "entity_id string, doc_id long")
    asked = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("x", "y")], "a string, b string")
    got = {(r.a, r.b, r.section, r.predicate, r.doc_id, r.n_a, r.n_b) for r in W.pairs(asked, spans, mentions).collect()}
    assert got == {("a", "b", "direct", "p", None, None, None), ("a", "b", "superseded", "q", None, None, None), ("a", "b", "shared", None, 1, 2, 1), ("a", "a", "direct", "self", None, None, None)}
    named = spark.createDataFrame([("s", "Subject"), ("t", "Other")], "id string, name string")
    trail = spark.createDataFrame([("s", 4, "name changed")], "id string, at int, change string")
    ents = spark.createDataFrame([(1, "E", "pending", 0.5, "d1")], "proposal_id long, name string, state string, confidence double, doc_id string")
    rels = spark.createDataFrame([(2, "s", "knows", "t", "approved", 0.5, "d1"), (3, "s", "knows", "t", "approved", 0.5, "other")], "proposal_id long, subject string, predicate string, object string, state string, confidence double, doc_id string")
    docs = spark.createDataFrame([("s", "d1", 3, "mail", "done")], "id string, doc_id string, at int, source string, state string")
    proof = spark.createDataFrame([("s", "s", "likes", "d1", 5), ("t", "s", "knows", "d1", 6)], "source string, target string, predicate string, source_doc string, at int")
    rows = {(r.section, r.at, r.detail) for r in W.subjects(named.select("id").filter("id = 's'"), named, trail, W.proposals_of(ents, rels), docs, proof).collect()}
    assert rows == {("subject", None, "Subject"), ("trail", 4, "name changed"), ("ingest", 3, "d1 mail done"), ("proposal", None, "entity 1 pending"), ("proposal", None, "relation 2 approved"),
                    ("evidence", 5, "source likes s"), ("evidence", 6, "target knows t")}


def test_effects_of_approval(spark):
    spo = "proposal_id long, subject string, predicate string, object string"
    proposals = spark.createDataFrame([(1, "a", "p", "b", "d1", 0.5), (2, "a", "p", "b", "d1", 0.7), (3, "a", "p", "b", "d2", 0.6), (4, "x", "p", "y", "d1", 0.9), (5, "c", "p", "d", None, 2.0)], f"{spo}, doc_id string, confidence double")
    outcomes = proposals.select("proposal_id", "subject", "predicate", "object", F.when(F.col("proposal_id") == 4, "blocked").otherwise("kept").alias("outcome"))
    evidence = spark.createDataFrame([("a", "p", "b", "d2", 0.9), ("q", "p", "r", "d9", 0.9)], "subject string, predicate string, object string, source string, confidence double")
    new, scored = C.evidence_of_approved(proposals, outcomes, evidence)
    assert {(r.subject, r.source, r.confidence) for r in new.collect()} == {("a", "d1", 0.7), ("c", None, 1.0)}
    assert {(r.subject, r.sources, r.confidence) for r in scored.collect()} == {("a", 2, 0.928), ("c", 1, 1.0)}
    ents = spark.createDataFrame([(1, "d1", 0.4), (2, "d1", 0.8), (3, None, 0.5), (4, "d2", 0.5)], "proposal_id long, doc_id string, confidence double")
    resolved = spark.createDataFrame([(1, "7"), (2, "7"), (3, "7"), (4, "8")], "proposal_id long, entity_id string")
    there = spark.createDataFrame([(8, "d2")], "entity_id long, doc_id string")
    assert [tuple(r) for r in C.mentions_of_approved(ents, resolved, there).collect()] == [("7", "d1", 0.8)]
    listed = spark.createDataFrame([(1, "n1", 1, 0.555, "pending", "d1"), (2, "n2", 9, 0.9, "pending", None), (3, "n3", 1, 0.99, "approved", "d1")], "proposal_id long, name string, kind_id int, confidence double, state string, doc_id string")
    shown = C.pending_list(listed, spark.createDataFrame([(1, "kind")], "kind_id int, name string"), spark.createDataFrame([("d1", "Doc")], "doc_id string, name string")).collect()
    assert [tuple(r) for r in shown] == [(2, "n2", None, 0.9, None), (1, "n1", "kind", 0.56, "Doc")]


def test_evaluation(spark):
    expected = spark.createDataFrame([("c1", 1, "Mara Quinn", "Lumen Inc"), ("c1", 2, "Lumen", "Devin Osei"), ("c2", 1, "A B", "the Inc"), ("c3", 1, "North", "South")], "case_id string, relation_id int, subject string, object string")
    found = spark.createDataFrame([("c1", "mara", "LUMEN"), ("c1", "Lumen", "Mara"), ("c1", "Devin", "Lumen"), ("c2", "A B", "the Inc")], "case_id string, subject string, object string")
    judged = A.directions(expected, found)
    assert {(r.case_id, r.relation_id): r.verdict for r in judged.collect()} == {("c1", 1): "correct", ("c1", 2): "reversed", ("c2", 1): "missing", ("c3", 1): "missing"}
    s = A.direction_summary(judged.withColumn("all", F.lit(1)), ["all"]).first()
    assert (s.total, s.correct, s.reversed, s.missing, s.accuracy, s.error_rate, s.precision) == (4, 1, 1, 2, 0.25, 0.75, 0.5)
    scenarios = spark.createDataFrame([(1, "x", "search"), (2, "x", "search"), (3, "y", "none"), (4, "y", "none"), (5, "y", "search"), (6, "y", "save_memory")], "scenario_id long, category string, expected string")
    calls = spark.createDataFrame([(1, 2, "why"), (1, 1, "search"), (2, 1, "save_memory"), (3, 1, "why"), (5, 1, None), (6, 1, "save_memory")], "scenario_id long, step int, tool string")
    got = {r.category: (r.n, r.correct, r.misuses, r.percent) for r in A.adherence(scenarios, calls).collect()}
    assert got == {"x": (2, 1, 1, 50.0), "y": (3, 2, 1, 66.7), None: (5, 3, 2, 60.0)}
    ranked = spark.createDataFrame([("q1", 1, "It is: the BLUE, house"), ("q1", 2, "red"), ("q2", 1, "no"), ("q2", 2, "yes it is")], "question_id string, rank int, text string")
    answers = spark.createDataFrame([("q1", "blue house!"), ("q2", "Yes"), ("q3", "x")], "question_id string, answer string")
    rows = {r.question_id: (r.r_at_1, r.r_at_2, r.exact, r.f1) for r in A.retrieval_quality(ranked, answers, [1, 2]).collect()}
    assert rows == {"q1": (True, True, True, 0.571429), "q2": (False, True, False, 0.0), "q3": (False, False, False, 0.0)}


def test_exports_without_a_head_and_as_documents(spark):
    nodes = spark.createDataFrame([("c", "r", None, 1.0), ("c", "a", "r", 2.0), ("c", "b", "r", 3.0), ("d", "y", None, None), ("d", "x", None, None), ("d", "z", None, 1.0), ("e", "q", None, 1.0)], "conv_id string, node string, parent string, at double")
    heads = spark.createDataFrame([("c", "b"), ("d", "gone"), ("e", None)], "conv_id string, node string")
    got = {(r.conv_id, r.position): r.node for r in exports.active_messages(nodes, heads).collect()}
    assert got == {("c", 0): "r", ("c", 1): "b", ("d", 0): "z", ("d", 1): "x", ("d", 2): "y", ("e", 0): "q"}
    at = dt.datetime(2024, 2, 3, 4, 5, 6)
    turns = spark.createDataFrame([("c", 1, "assistant", "yes", None), ("c", 0, "user", "hi", at), ("c", 2, "user", "  ", None), ("d", 0, "x", None, None)], "conv_id string, position int, role string, text string, at timestamp")
    about = spark.createDataFrame([("c", "Title", at, None), ("d", None, None, None)], "conv_id string, title string, created_at timestamp, updated_at timestamp")
    text = exports.render_export(turns, about, "Chat").collect()
    assert [r.text for r in text] == ["Chat Conversation: Title\nConversation ID: c\nCreated: 2024-02-03T04:05:06.000Z\n\nUser (2024-02-03T04:05:06.000Z):\nhi\n\nAssistant:\nyes"]
    s = exports.span(about.select("conv_id", "created_at", F.lit(dt.datetime(2025, 1, 1)).alias("updated_at"))).first()
    assert (s.conversations, s.earliest, s.latest) == (2, at, dt.datetime(2025, 1, 1))
    days = [(dt.date(2024, 1, 5), dt.date(2024, 1, 9)), (dt.date(2024, 1, 5), dt.date(2026, 6, 1)), (dt.date(2024, 1, 5), None), (None, dt.date(2024, 1, 5)), (None, None)]
    shown = spark.createDataFrame(days, "a date, b date").select(exports.described(F.lit(1240), "Chat", F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in shown] == [f"1,240 Chat conversations {x}".strip() for x in ("from Jan 2024", "from Jan 2024 to Jun 2026", "from Jan 2024", "through Jan 2024", "")]


def test_proposals_settings_guards_and_boosts(spark):
    rows = [("w", "a", "entity", " N ", "k", [" x ", "x", ""], None, None, None, "d", 0.5), ("w", "a", "entity", "N", "k", None, None, None, None, "c", 0.9), ("w", "a", "entity", " ", "k", None, None, None, None, None, 0.9),
            ("w", "b", "relation", None, None, None, "1", "now Likes", "2", None, None), ("w", "b", "relation", None, None, None, "1", None, "2", None, 1.0), ("w", "b", None, None, None, None, "1", None, "2", None, 1.0)]
    facts = spark.createDataFrame(rows, "workspace string, agent string, kind string, name string, entity_kind string, aliases array<string>, subject string, predicate string, object string, doc_id string, confidence double")
    entities, relations, rejected = C.proposed(facts)
    assert [(r.name, r.made_by, r.aliases, r.confidence, r.state) for r in entities.collect()] == [("N", "agent:a", ["x"], 0.9, "pending")]
    assert [(r.subject, r.predicate, r.object, r.confidence, r.state) for r in relations.collect()] == [("1", "likes", "2", 0.5, "pending")]
    assert sorted((r.agent, r.problem) for r in rejected.collect()) == [("a", "name"), ("b", "kind"), ("b", "predicate")]
    proposals = spark.createDataFrame([(1, "w", "k", 0.5), (2, "v", "k", 0.5), (3, None, "k", 0.7), (4, "w", "other", 0.9)], "id long, workspace string, kind string, confidence double")
    settings = spark.createDataFrame([("w", "0.4"), ("v", "2")], "workspace string, least string")
    states = {r.id: (r.threshold, r.state) for r in C.promote_by_setting(proposals, spark.createDataFrame([("k",)], "kind string"), settings).collect()}
    assert states == {1: (0.4, "promoted"), 2: (0.6, "pending"), 3: (0.6, "promoted"), 4: (0.4, "pending")}
    known = spark.createDataFrame([("w", "active"), ("off", "disabled")], "workspace string, status string")
    docs = spark.createDataFrame([("w", "done"), ("w", "error")], "workspace string, state string")
    assert C.processed(Session({"d": docs}, "w", workspaces=known).table("d")).count() == 1
    for name, error in (("off", PermissionError), ("none", LookupError)):
        with pytest.raises(error):
            Session({"d": docs}, name, workspaces=known)
    ents = spark.createDataFrame([(1, "Northwind Coffee", ["NW"]), (2, "Other", ["nw coffee"]), (3, "Third", None)], "entity_id long, name string, aliases array<string>")
    mentions = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, 12)], "entity_id long, doc_id long")
    assert {r.doc_id: r.boost for r in R.entity_boosts(ents, mentions, "what of nw").collect()} == {10: 0.4}
    assert R.entity_boosts(ents, mentions, "?").count() == 0
    names = spark.createDataFrame([("k", "a b c"), ("k", "a b"), ("k", "c"), ("k", "z")], "kind string, name string")
    assert {r.canonical: r.aliases for r in C.aliases_of(C.resolve_names(names)).collect()} == {"a b c": ["a b", "c"], "z": []}


def test_hybrid_sorts_and_related(spark):
    docs = spark.createDataFrame([(1, "apple pie", 3), (2, "apple", 2), (3, "pear", 1)], "doc_id long, text string, created_at int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "doc_id long, embedding array<double>")
    turned = lambda found: found.withColumn("score", -F.col("score"))
    ids = lambda **k: [r.doc_id for r in R.hybrid(docs, vectors, [1.0, 0.0], "apple", 3, reranker=turned, **k).collect()]
    assert ids() == [3, 1, 2] or ids() == [3, 2, 1]
    scores = [r.score for r in R.hybrid(docs, vectors, [1.0, 0.0], "apple", 3, sort="date_asc", reranker=turned).collect()]
    assert ids(sort="date_asc") == [3, 2, 1] and max(scores) > 0  # under a date the reranker is not asked
    found = R.hybrid_eval(docs, vectors, [1.0, 0.0], "the apple pie", 3, ["the"]).collect()
    assert [(r.doc_id, r.boost) for r in found] == [(1, 0.15), (2, 0.1), (3, 0.05)] and found[0].vector_score == 1.0
    assert [r.doc_id for r in R.temporal(lambda n: R.hybrid(docs, vectors, [1.0, 0.0], "apple", n), 2).collect()] == [1, 2]
    edges = spark.createDataFrame([("k", "doc", 1, "part", 2, "has", 0.9), ("k", "doc", 1, "part", 3, "has", 0.5), ("k", "person", 4, "doc", 1, "wrote", 0.9), ("k", "doc", 1, "part", 5, "is", 0.9)], "kind string, src_kind string, src long, dst_kind string, dst long, predicate string, confidence double")
    seeds = spark.createDataFrame([("doc", 1)], "kind string, id long")
    assert {r.other for r in G.related(edges, seeds, least=0.6, predicates=["has", "wrote"]).collect()} == {2, 4}
    assert {r.other for r in G.related(edges, seeds, "out", kinds=["part"]).collect()} == {2, 3, 5}


def test_health_and_breakdown(spark):
    make = spark.createDataFrame
    edges = make([(None, 0.5), (5, 0.9), (50, 0.7)], "valid_to int, confidence double")
    proposals = make([("pending", None, "d"), ("approved", "e", None), ("rejected", None, "d")], "state string, entity_id string, doc_id string")
    types = make([("pending", "entity_kind"), ("pending", "subtype"), ("auto_promoted", "relation_type"), ("pending", "relation_type")], "state string, kind string")
    evidence = make([("entity_relation", "r", "d1"), ("entity_relation", "r", "d2"), ("entity_relation", "q", "d1"), ("mention", "s", "d1"), ("mention", "s", "d2"), ("entity_relation", None, "d3")], "kind string, row_id string, doc_id string")
    events = make([("k", "completed"), (None, "dead_lettered")], "idempotency_key string, status string")
    h = A.health({"entity_edges": edges, "entity_proposals": proposals, "type_proposals": types, "evidence": evidence, "events": events, "people": edges, "doc_people": edges}, F.lit(10)).first().asDict()
    want = {"relations": 6, "relations_superseded": 1, "mean_relation_confidence": 0.6, "entities_pending": 1, "entities_promoted": 1, "source_backed_pct": 66.7, "types_pending": 2, "entity_kinds_pending": 1,
            "relation_types_pending": 1, "types_auto_promoted": 1, "relations_corroborated": 1, "memory_writes": 2, "writes_keyed": 1, "writes_dead": 1, "people": 3, "documents": 0, "relations_pending": 0}
    assert {k: h[k] for k in want} == want
    none = A.health({"people": edges.limit(0)}, F.lit(1)).first()
    assert (none.source_backed_pct, none.mean_relation_confidence, none.relations) == (100.0, None, 0)
    with pytest.raises(ValueError):
        A.health({}, F.lit(1))
    docs = make([("w", "a", False), ("w", "a", True), ("v", "a", False), ("v", "b", False)], "workspace string, agent_id string, is_action boolean")
    agents = make([("w", "a", "Ann")], "workspace string, agent_id string, label string")
    assert {tuple(r) for r in A.breakdown(docs, agents, ("workspace", "agent_id")).collect()} == {("w", "a", 1, "Ann"), ("v", "a", 1, "a"), ("v", "b", 1, "b")}


def test_invalid_writes_go_to_quarantine(spark, tmp_path):
    schema = "idempotency_key string, trace_id string, kind string"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for rows in ([("k", "t", "fact"), (" ", "t", "fact")], [("k2", None, "fact"), ("k3", "t", "")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        pipelines.quarantine_stream(stream, *(str(tmp_path / x) for x in ("offsets", "good", "bad")))
    assert [r.idempotency_key for r in spark.read.parquet(str(tmp_path / "good")).collect()] == ["k"]
    assert {(r.problem, r.batch) for r in spark.read.parquet(str(tmp_path / "bad")).collect()} == {("idempotency_key", 0), ("trace_id", 1), ("kind", 1)}
