"""Stored indexes, batches, forests, streams and logs against plain versions, on small fixtures."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from loomspark.functions import stems
from loomspark.functions import variants as V
from loomspark.operators import analytics, cells, commits, forest, fulltext, query_log, saves, trigrams
from loomspark.sources import benchmarks
from loomspark.streaming import edges as live
from pyspark.sql import functions as F


def test_stems(spark):
    # after the examples of the algorithm's paper
    want = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
        "conflated": "conflat", "sized": "size", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "rational": "ration",
        "digitizer": "digit", "operator": "oper", "decisiveness": "decis", "formalize": "formal", "hopeful": "hope", "goodness": "good", "replacement": "replac", "adoption": "adopt",
        "effective": "effect", "rate": "rate", "controll": "control", "is": "is", "42s": "42",
    }
    rows = stems.with_stem(spark.createDataFrame([(w,) for w in want], "word string")).collect()
    assert {r.word: r.term for r in rows} == want


def full_scan(texts, queries, k):
    out = {}
    for q, text in queries:
        hits = []
        for d, t in texts:
            score = round(sum(t[w] / (t[w] + 1) for w in set(text) & t.keys()), 6)
            if set(text) & t.keys():
                hits.append((-score, d))
        out[q] = [(d, -s) for s, d in sorted(hits)[:k]]
    return out


def test_full_text_index_equals_a_scan_and_skips(spark, tmp_path):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(3000) if i not in (17, 2000, 2001)] + [(5000, None), (5001, ""), (5002, "the and of")]
    # a word that repeats in a few documents only: their ranges are enough
    docs += [(i, "gold gold gold gold") for i in (17, 2000, 2001)] + [(i, "gold") for i in range(10_000, 14_000, 10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    path = str(tmp_path / "index")
    fulltext.append(path, frame.filter("doc_id % 3 = 0"), "a")
    for _ in range(2):  # a batch that runs again replaces itself
        fulltext.append(path, frame.filter("doc_id % 3 <> 0"), "b")
    index = fulltext.opened(spark, path)
    queries = [(1, "word1 word2 word3"), (2, "gold"), (3, "nothing here"), (4, "words word5 WORD5"), (5, "the")]
    asked, told = spark.createDataFrame(queries, "query_id long, text string"), {}
    got = fulltext.search(index, asked, 3, told=told).collect()
    stem = lambda t: [w.lower().replace("words", "word") for w in (t or "").split() if w not in ("the", "and", "of", "here")]
    plain = [(d, {w: stem(t).count(w) for w in stem(t)}) for d, t in dict(docs).items()]
    want = full_scan([(d, t) for d, t in plain], [(q, stem(t)) for q, t in queries], 3)
    found = {q: [] for q, _ in queries}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.doc_id, r.score))
    assert found == want and want[3] == want[5] == []
    assert told["scored"] < told["ranges"]
    one = fulltext.search(index, asked.filter("query_id = 2"), 3, told=(only := {}))
    assert [r.doc_id for r in one.orderBy("rank").collect()] == [17, 2000, 2001] and only["scored"] <= fulltext.FIRST < only["ranges"]
    total = {r.query_id: r.total for r in fulltext.matching(index, asked).collect()}
    assert total == {q: n for q, t in queries if (n := sum(1 for _, own in plain if set(stem(t)) & own.keys()))}


def test_full_text_reads_the_folders_and_stems_asked_for(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"alpha{i} beta gamma{i % 50}") for i in range(500)], "doc_id long, text string")
    fulltext.append(str(tmp_path / "index"), frame, "a")
    index = fulltext.opened(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "alpha7")], "query_id long, text string")
    scan = fulltext.wanted(index, fulltext.query_terms(asked))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term), EqualTo(term,alpha7)]" in plan
    assert scan.count() == 1 and len(scan.select(F.input_file_name()).distinct().collect()) == 1


def test_full_text_count_keeps_its_terms(spark, tmp_path):
    fulltext.append(str(tmp_path / "index"), spark.createDataFrame([(1, "alpha beta"), (2, "alphas")], "doc_id long, text string"), "a")
    index = fulltext.opened(spark, str(tmp_path / "index"))
    spark.createDataFrame([(1, "alpha"), (2, "none")], "query_id long, text string").write.parquet(str(tmp_path / "asked"))
    got = fulltext.matching(index, spark.read.parquet(str(tmp_path / "asked")))
    # without, the steps of the stem are copied into each other: planning did not end in 90 s
    assert "InMemoryRelation" in got._jdf.queryExecution().withCachedData().toString()
    assert [(r.query_id, r.total) for r in got.collect()] == [(1, 2)]


def test_nearest_cells_equal_a_scan(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 8)) * 3
    rows = [(i, [float(x) for x in centres[i % 6] + rng.standard_normal(8) * 0.2]) for i in range(900)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, None), (1003, [0.0] * 8), (1004, [1.0, 2.0]), (1005, [float("nan")] + [1.0] * 7), (1006, [1e-200] * 8), (1007, [1e200] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = cells.build(frame, str(tmp_path / "cells"), cells=12)
    told = {}
    got = cells.search(index, frame.filter("vec_id % 20 = 0 OR vec_id >= 1000"), 5, first=2, told=told).collect()
    own = {i: np.array(v) / np.abs(v).max() for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    own = {i: v / np.linalg.norm(v) for i, v in own.items()}
    want = {}
    for q in (i for i in own if i % 20 == 0 or i >= 1000):
        best = sorted((-round(float(own[q] @ v), 6), i) for i, v in own.items())[:5]
        want |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(best)}
    assert {(r.query_id, r["rank"]): (r.id, r.sim) for r in got} == want
    assert told["read"] < told["cells"] * 0.6
    assert cells.build(frame.limit(0), str(tmp_path / "none")) is None


def test_trigrams_equal_a_scan(spark, tmp_path):
    rng = random.Random(1)
    names = [(i, "".join(rng.choice("abcAB é") for _ in range(rng.randint(0, 12)))) for i in range(6000)] + [(7000, None), (None, "abc"), (7001, "xyz%_z")]
    frame = spark.createDataFrame(names, "id long, name string")
    trigrams.append(str(tmp_path / "grams"), frame.filter("id < 3000 OR id IS NULL"), "a", "id", "name")
    trigrams.append(str(tmp_path / "grams"), frame.filter("id >= 3000"), "b", "id", "name")
    parts = [(1, "abc"), (2, "ABca"), (3, "b é"), (4, "z%_"), (5, "nope"), (6, "ab"), (7, "abcabc"), (8, "bbb"), (9, None)]
    got = trigrams.holding(trigrams.opened(spark, str(tmp_path / "grams")), frame, spark.createDataFrame(parts, "query_id long, part string"), "id", "name").collect()
    want = {(q, i, n) for q, p in parts if p and len(p) >= 3 for i, n in names if i is not None and n and p.lower() in n.lower()}
    assert {(r.query_id, r.id, r.name) for r in got} == want and len(got) == len(want)


def request(i, workspace="w", agent="a", key=None, trace="t", at=None, content="text"):
    return (workspace, agent, key or f"k{i}", trace, None, None, content, "{}", "test", at or dt.datetime(2024, 1, 1) + dt.timedelta(hours=i))


REQUEST = "workspace string, agent string, idempotency_key string, trace_id string, span_id string, causal_parent_id string, content string, payload string, source_label string, at timestamp_ntz"


def counts(store):
    return {t: store.read(t, s).count() for t, s in saves.SCHEMAS.items()}


def test_saves_are_whole_or_nothing(spark, tmp_path):
    store = commits.BatchStore(spark, str(tmp_path / "memory"))
    rows = [request(i) for i in range(12)] + [request(3), request(4, agent="b", key="other"), request(5, trace=" "), request(5, key=" "), request(6, content=None, key="empty")]
    frame = spark.createDataFrame(rows, REQUEST)

    def dies(table):
        if table == "chunks":
            raise RuntimeError("the run dies here")

    with pytest.raises(RuntimeError):
        saves.save_memories(store, "one", frame, between=dies)
    assert set(counts(store).values()) == {0} and store.committed() == []
    assert saves.save_memories(store, "one", frame)
    want = {"events": 14, "documents": 14, "chunks": 14, "evidence": 15, "sessions": 2, "notes": 14, "milestones": 1, "rejected": 2}
    assert counts(store) == want
    assert not saves.save_memories(store, "one", frame) and saves.save_memories(store, "again", frame.filter("trim(trace_id) <> '' AND trim(idempotency_key) <> ''"))
    assert counts(store) == want and store.committed() == ["again", "one"]
    more = spark.createDataFrame([request(100 + i, content="x" * 200) for i in range(40)] + [request(200, workspace="v")], REQUEST)
    assert saves.save_memories(store, "two", more)
    made = store.read("milestones", saves.SCHEMAS["milestones"]).orderBy("count").collect()
    assert [(m["count"], m.message) for m in made] == [(10, "Stored the 10th memory in this workspace."), (50, "Stored the 50th memory in this workspace.")]
    notes = store.read("notes", saves.SCHEMAS["notes"]).filter("workspace = 'w' AND agent = 'a'")
    assert notes.select("session_id").distinct().count() == 1
    name = store.read("documents", saves.SCHEMAS["documents"], ["two"]).filter("workspace = 'w'").first().name
    assert len(name) == 120 and name.endswith("...")
    edge = store.read("evidence", saves.SCHEMAS["evidence"]).filter("kind = 'agent_agent'").collect()
    assert [(e.source, e.target, e.predicate) for e in edge] == [("b", "a", "shares_trace")]
    for bad in ("", "a/b", "_x"):
        with pytest.raises(ValueError):
            store.commit(bad, {})


def test_recalls_and_ordinals(spark):
    log = spark.createDataFrame([("w", "a", "d1"), ("w", "a", "d1"), ("w", "b", "d1"), ("w", "a", "d2")], "workspace string, agent string, document_id string")
    docs = spark.createDataFrame([("w", "b", "d1"), ("w", "a", "d2")], "workspace string, agent string, document_id string")
    assert [(r.source, r.target, r.n) for r in saves.recalls(log, docs).collect()] == [("a", "b", 2)]
    shown = spark.range(1).select(*(saves.ordinal(F.lit(n)).alias(f"c{n}") for n in (1, 2, 3, 4, 11, 12, 13, 21, 102, 111, 1003))).first()
    assert list(shown) == ["1st", "2nd", "3rd", "4th", "11th", "12th", "13th", "21st", "102nd", "111th", "1,003rd"]


def test_upsert_touches_the_folders_of_its_keys_only(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "id long, name string, version int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    commits.upsert(spark, path, frame([(i, f"n{i}", 1) for i in range(200)] + [(None, "null key", 1)]), ["id"], "version", buckets=16)
    files = lambda: {p for p in (tmp_path / "table").rglob("part-*.parquet")}
    before = files()
    made = commits.upsert(spark, path, frame([(3, "new", 2), (5, "old", 0), (7, "n7", 1), (999, "more", 1), (None, "null again", 3)]), ["id"], "version", buckets=16).collect()
    assert {(r.id, r.op, r.old and r.old.name, r.new.name) for r in made} == {(3, "update", "n3", "new"), (999, "insert", None, "more"), (None, "update", "null key", "null again")}
    assert len(before & files()) >= 11  # of 16 folders at most 5 are replaced
    now = {r.id: r.name for r in commits.upserted(spark, path).collect()}
    assert now == {i: f"n{i}" for i in range(200)} | {3: "new", 999: "more", None: "null again"}


def test_forest(spark):
    rng = random.Random(6)
    chain = [("chain", i, i - 1 if i else None) for i in range(3000)]
    tree = [("tree", i, rng.randrange(i) if i else None) for i in range(500)] + [("tree", 900, 901), ("tree", 902, 900)]
    loop = [("loop", 1, 2), ("loop", 2, 3), ("loop", 3, 1), ("loop", 4, 1), ("loop", 5, 5), ("loop", 6, None), ("loop", 7, 6), ("loop", 7, 6), ("loop", None, 6)]
    rows = chain + tree + loop
    got = {(r.g, r.id): (r.root, r.depth, r.orphan, r.cyclic) for r in forest.ranked(spark.createDataFrame(rows, "g string, id long, p long"), "g", "id", "p").collect()}
    parent = {(g, i): p for g, i, p in rows if i is not None}
    for (g, i), p in parent.items():
        at, depth, seen = i, 0, set()
        while parent[(g, at)] is not None and (g, parent[(g, at)]) in parent and at not in seen:
            seen.add(at)
            at, depth = parent[(g, at)], depth + 1
        want = (None, None, False, True) if at in seen else (at, depth, p is not None and (g, p) not in parent, False)
        assert got[(g, i)] == want
    assert len(got) == len(parent)
    heads = spark.createDataFrame([("chain", 2500), ("tree", 499), ("loop", 7), ("none", 1), ("tree2", 1)], "g string, id long")
    found = forest.paths(spark.createDataFrame(rows, "g string, id long, p long"), heads, "g", "id", "p").collect()
    walked = {}
    for r in found:
        walked.setdefault(r.g, {})[r.position] = r.id
    for g, head in (("chain", 2500), ("tree", 499), ("loop", 7)):
        want = [head]
        while parent[(g, want[-1])] is not None:
            want.append(parent[(g, want[-1])])
        assert [walked[g][i] for i in range(len(want))] == want[::-1]
    assert set(walked) == {"chain", "tree", "loop"}


def test_variants(spark):
    rows = [('{"a": {"b": [1, 2]}, "c": "x"}',), ("[1]",), ("broken {",), (None,), ("{}",)]
    v = spark.createDataFrame(rows, "j string").select("j", V.parsed(F.col("j")).alias("v"))
    assert [r[0] for r in v.select(V.read(F.col("v"), "$.a.b[1]", "int")).collect()] == [2, None, None, None, None]
    out = v.select("j", F.to_json(V.with_field(F.col("v"), ["a", "n"], F.lit(1).cast("variant"))).alias("o")).collect()
    assert [json.loads(r.o) for r in out] == [{"a": {"b": [1, 2], "n": 1}, "c": "x"}, {"a": {"n": 1}}, {"a": {"n": 1}}, {"a": {"n": 1}}, {"a": {"n": 1}}]
    both = v.select(F.to_json(V.merged(F.col("v"), V.parsed(F.lit('{"c": null, "d": 2}')))).alias("o")).first().o
    assert json.loads(both) == {"a": {"b": [1, 2]}, "c": None, "d": 2}
    assert {(r.key, r.j) for r in V.listed(v, "v", "j").collect()} == {("a", rows[0][0]), ("c", rows[0][0])}
    assert v.select(V.first_of(F.col("v"), ["$.none", "$.c"])).first()[0] == "x"


def test_bounded_counts_stop_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 5 == 0, None).otherwise(F.pmod(F.col("id"), F.lit(2))).alias("k"), "id").union(spark.sql("SELECT 77L, -1L")).repartition(4)
    out = analytics.bounded(rows, ["k"], "id", 101)
    assert {r.k: r.n for r in out.collect()} == {None: 101, 0: 101, 1: 101, 77: 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_query_log(spark, tmp_path):
    log = query_log.QueryLog(spark, str(tmp_path / "log"))
    for n in (3, 5):
        with log.call("count", api_key="very secret", n=n) as call:
            assert call.observe(spark.range(n)).count() == n
    with pytest.raises(ZeroDivisionError), log.call("count", note="fails"):
        raise ZeroDivisionError
    rows = log.read().collect()
    assert sorted((r.status, r.rows) for r in rows if r.rows) == [("ok", 3), ("ok", 5)] and not any("secret" in str(r.input) for r in rows)
    m = query_log.running_metrics(log.read()).first()
    assert (m.tool, m.calls, m.failures, m.rows) == ("count", 3, 1, 8) and m.most_ms >= m.mean_ms > 0


def sightings(seed):
    rng = random.Random(seed)
    return [(rng.randrange(4), "did", rng.choice("xy"), rng.choice(["s1", "s2", "s3", None]), rng.choice([0.0, 0.2, 0.5, 0.9, 1.7, None, float("nan")])) for _ in range(120)]


def test_live_edges_agree_with_a_batch(spark, tmp_path):
    rows, schema = sightings(2), "subject long, predicate string, object string, source string, confidence double"
    results = []
    for order in (0, 1):
        given = rows[:]
        random.Random(order).shuffle(given)
        given += given[:30]  # repeated and late
        source = tmp_path / f"in{order}"
        for i in range(3):
            spark.createDataFrame(given[i::3], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        live.run_live_edges(stream, str(tmp_path / f"c{order}"), str(tmp_path / f"e{order}"))
        now = live.edges_now(spark.read.parquet(str(tmp_path / f"e{order}"))).collect()
        results.append({(r.subject, r.object): (r.sources, r.confidence) for r in now})
        assert all(r.made_in is not None for r in now)
    best = {}
    for s, _, o, source, c in rows:
        c = 0.0 if c is None or c != c else min(max(c, 0.0), 1.0)
        best.setdefault((s, o), {}).setdefault(source, 0.0)
        best[(s, o)][source] = max(best[(s, o)][source], c)
    want = {}
    for key, sources in best.items():
        some = sorted((c for c in sources.values() if c > 0), reverse=True)
        left = 1.0
        for c in some[1:]:
            left *= 1 - 0.4 * c
        want[key] = (len(some), round(min(max(0.95, some[0]), 1 - (1 - some[0]) * left), 6) if some else 0.0)
    assert results[0] == want and results[1] == want


def test_stream_sessions_and_late_notes(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[("a", at(0)), ("a", at(20)), ("b", at(5))], [("a", at(100)), ("b", at(25))], [("a", at(21)), ("c", at(400))], [("c", at(900))]]
    source = tmp_path / "notes"
    source.mkdir()
    stream = spark.readStream.schema("actor string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    made = live.sessions(stream, "actor", "at", "30 minutes", "10 minutes")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "actor string, at timestamp").coalesce(1).write.mode("append").parquet(str(source))
        made.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "s")).format("parquet").trigger(availableNow=True).start().awaitTermination()
    out = {(r.actor, r.started_at, r.ended_at, r.notes) for r in spark.read.schema(made.schema).parquet(str(tmp_path / "s")).collect()}
    # the note of a at minute 21 came behind the watermark (90) and changes nothing
    assert out == {("a", at(0), at(20), 2), ("b", at(5), at(25), 2), ("a", at(100), at(100), 1), ("c", at(400), at(400), 1)}


def test_benchmark_loader(spark, tmp_path):
    rows = [
        {"question_id": "q1", "question": "who?", "answer": 7, "question_type": "multi", "haystack_sessions": [[{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}, "junk"], []],
         "haystack_dates": ["2023/04/10 (Mon) 17:50", "2023/04/11"], "haystack_session_ids": ["s1", "s2"], "answer_session_ids": ["s2"]},
        {"id": "q2", "answer_span": "span", "answer": "a", "category": "old", "context": [{"role": "human", "content": "flat"}, {"content": None}]},
        {"question_id": "q3", "sessions": []},
    ]
    (tmp_path / "array.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows) + "\nnot json\n")
    for name in ("array.json", "lines.json"):
        got = benchmarks.load(spark, str(tmp_path / name)).collect()
        assert [(r.question_id, r.question, r.answer, r.answer_span, r.category) for r in got] == [("q1", "who?", "7", "7", "multi"), ("q2", "", "a", "span", "old"), ("q3", "", "", "", "unknown")]
        assert [[[tuple(t) for t in s] for s in r.sessions] for r in got] == [[[("user", "hi"), ("assistant", "yo")], []], [[("human", "flat"), ("user", "")]], []]
        assert got[0].answer_session_ids == ["s2"] and got[1].session_ids == []
    texts = benchmarks.session_texts(benchmarks.load(spark, str(tmp_path / "array.json"))).orderBy("question_id", "session").collect()
    assert [(r.session_id, r.date, r.text) for r in texts[:2]] == [("s1", dt.datetime(2023, 4, 10, 17, 50), "[User]: hi\n[Assistant]: yo"), ("s2", dt.datetime(2023, 4, 11), "")]
    dates = spark.createDataFrame([("2023/04/10 (Mon) 17:50:09",), ("2023-04-10",), ("",), (None,)], "d string").select(benchmarks.benchmark_date(F.col("d"))).collect()
    assert [r[0] for r in dates] == [dt.datetime(2023, 4, 10, 17, 50, 9), None, None, None]
    many = spark.createDataFrame([(f"q{i}", "x") for i in range(50)], "question_id string, question string")
    pick = lambda df, seed: [r.question_id for r in benchmarks.chosen(df, 9, seed).collect()]
    assert pick(many, 1) == pick(many.repartition(7), 1) != pick(many, 2)
    scored = spark.createDataFrame([("q1", "multi", True, 0.5), ("q2", "old", False, 1.0)], "question_id string, category string, ev_at_5 boolean, f1 double")
    benchmarks.write_results(scored, str(tmp_path / "out"), {"strategy": "hybrid"}, ["category"], ["ev_at_5", "f1"])
    summary = spark.read.json(str(tmp_path / "out/summary")).collect()
    assert {(r.category, r.questions, r.ev_at_5, r.f1, r.run.strategy) for r in summary} == {(None, 2, 0.5, 0.75, "hybrid"), ("multi", 1, 1.0, 0.5, "hybrid"), ("old", 1, 0.0, 1.0, "hybrid")}
    assert spark.read.json(str(tmp_path / "out/questions")).count() == 2


def test_full_text_stems_each_word_once(spark, tmp_path, monkeypatch):
    stemmed, real = [], fulltext.with_stem
    monkeypatch.setattr(fulltext, "with_stem", lambda rows, *more: stemmed.append(rows.count()) or real(rows, *more))
    # words of one stem in one document, the largest and least ids of ranges, a null id, and ids that two batches share
    given = [(i, "alpha alphas beta " * (1 + i % 3)) for i in (-257, -256, -1, 0, 63, 64, 127, 128, 255, 256, 2**40)] + [(None, "alpha"), (3, None)]
    frame, path = spark.createDataFrame(given, "doc_id long, text string"), str(tmp_path / "index")
    fulltext.append(path, frame, "a")
    fulltext.append(path, frame.filter("doc_id < 64"), "b")
    assert stemmed == [3, 3]
    index = fulltext.opened(spark, path)
    assert {(r.term, tuple(r.docs), tuple(r.counts)) for r in index.filter("batch = 'a' AND range = 0").collect()} == {
        ("alpha", (0, 63, 64, 127, 128, 255), (2, 2, 4, 4, 6, 2)), ("beta", (0, 63, 64, 127, 128, 255), (1, 1, 2, 2, 3, 1))
    }
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "none")], "query_id long, text string")
    assert {(r.query_id, r.total) for r in fulltext.matching(index, asked).collect()} == {(1, 12), (2, 11)}


def test_live_edges_go_on_from_their_state_without_python(spark, tmp_path, monkeypatch):
    plans, real = [], live.drain
    monkeypatch.setattr(live, "drain", lambda stream, *more: plans.append(stream._jdf.queryExecution().analyzed().toString()) or real(stream, *more))
    schema = "subject long, predicate string, object string, source string, confidence double"
    calls = [
        [(1, "did", "x", "s1", 0.5), (1, "did", "x", None, 0.0), (2, "did", "y", "s1", None)],
        [(1, "did", "x", "s1", 0.5), (1, "did", "x", "s1", 0.4)],  # repeated and lower: nothing is raised
        [(1, "did", "x", "s1", 0.8), (1, "did", "x", None, 0.7), (3, "did", "x", "s1", 1.0)],
        [(2, "did", "y", "s2", 0.25), (1, "did", "x", "s1", 0.9), (1, "did", "x", "s1", 0.95)],
    ]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_live_edges(stream, str(tmp_path / "c"), str(tmp_path / "e"))  # nothing has come yet
    now = []
    for rows in calls:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live.run_live_edges(stream, str(tmp_path / "c"), str(tmp_path / "e"))
        now.append({(r.subject, r.sources, r.confidence) for r in live.edges_now(spark.read.parquet(str(tmp_path / "e"))).collect()})
    assert now[0] == now[1] == {(1, 1, 0.5), (2, 0, 0.0)}
    assert now[2] == {(1, 2, round(1 - 0.2 * 0.72, 6)), (2, 0, 0.0), (3, 1, 1.0)}
    assert now[3] == {(1, 2, 0.95), (2, 1, 0.25), (3, 1, 1.0)}
    rows = spark.read.parquet(str(tmp_path / "e")).collect()
    assert sorted((r.subject, r.batch) for r in rows if r.created) == [(1, 0), (2, 0), (3, min(r.batch for r in rows if r.subject == 3))]
    assert not any("TransformWithState" in p or "Pandas" in p for p in plans)
