"""Operators 12 and 13 against plain versions, on small fixtures with nulls, empties, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from loomspark.llm import fill_middle, prefix_trie
from loomspark.llm.shared import scratch
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\v\f\r"


def plain_starts(t, unit):
    if unit == "code_point":
        return list(range(len(t)))
    if unit == "line":
        return [i for i in range(len(t)) if not i or t[i - 1] == "\n"]
    return [i for i in range(len(t)) if not i or (t[i] not in SPACE and t[i - 1] in SPACE)]


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_cuts_of_the_block_tree(monkeypatch, unit):
    monkeypatch.setattr(fill_middle, "BLOCK", 8)
    rng = random.Random(unit)
    for _ in range(300):
        t = "".join(rng.choice(["a", "é", "東", " ", "\n", "😀", "b", "  "]) for _ in range(rng.randint(1, 90)))
        tree, starts = fill_middle.BlockTree.of(np.frombuffer(t.encode(), np.uint8), unit), plain_starts(t, unit)
        assert tree.units == len(starts)
        for k in range(len(starts) + 1):
            end = starts[k] if k < len(starts) else len(t)
            assert tree.cut(k) == (len(t[:end].encode()), end)


def plain_middle(doc_id, text, unit="code_point"):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    starts = [*plain_starts(t, unit), len(t)]
    n = len(starts) - 1
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = (starts[k] for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["code_point", "word", "line"])
def test_fill_in_middle(spark, unit):
    rng = random.Random(5)
    texts = [None, "", " ", "x", "é😀", "has <M> inside", "<P", "a<", "<S><", "<" * 50, "東京 é\n" * 9000, "w " * 200_000]
    texts += ["".join(rng.choice("ab <>PSM\né東") for _ in range(rng.randint(1, 3000))) for _ in range(150)]
    rows = [(i, t, "kept", 7) for i, t in enumerate(texts)] + [(None, "no id here", "kept", 7), (9, "again", None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, extra long").repartition(3)
    done = fill_middle.fill_in_middle(docs.withColumnRenamed("form", "Kept"), unit=unit)
    assert done.columns == ["doc_id", "text", "Kept", "extra", *fill_middle.ADDED]
    out = done.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text, unit)
        assert r.back == (r.text or "")
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs, unit=unit).columns == ["doc_id", "text", "extra", *fill_middle.ADDED]  # its own form is replaced
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def plain_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(conv, []).append(((turn is not None, turn or 0), digest, len(WORD.findall(text or ""))))
    turns = {c: sorted(t) for c, t in turns.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [x[1:] for x in turns.get(c - c % 20, [])[:h] + turns[c][h:]]
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(x[0] for x in t[:d]), []).append((c, t[d - 1][1] if d else 0, d == len(t)))
    below = {}
    for key in nodes:
        for d in range(len(key) + 1):
            below.setdefault(key[:d], []).append(key)
    children = {}
    for key in nodes:
        if key:
            children[key[:-1]] = children.get(key[:-1], 0) + 1
    out = set()
    for key, members in nodes.items():
        ends = ",".join(str(c) for c, _, last in sorted(members) if last)
        saved = sum((len(nodes[k]) - 1) * nodes[k][0][1] for k in below[key])
        leaves = sum(1 for k in below[key] if k not in children)
        parent = min(c for c, _, _ in nodes[key[:-1]]) if key else None
        out.add((min(c for c, _, _ in members), len(key), parent, len(members), children.get(key, 0), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(130), 90):
        same = rng.random() < 0.4
        for turn in range(rng.randint(1, 7)):
            text = f"turn {turn}" if same else rng.choice(["yes no", "a b c", "", None, f"x{c}"])
            rows.append((c, rng.choice([turn, None, turn // 2]) if rng.random() < 0.2 else turn, rng.choice(["user", "bot", None]) if not same else "user", text))
    rows += rows[5:8] + [(None, 1, "user", "nobody's")]
    rows += [(60, i, "user", f"long {i % 7}") for i in range(300)]
    return rows


@pytest.mark.parametrize(("large", "span", "doubled"), [(50_000, 4096, 10**6), (3, 5, 40)])
def test_prefix_trie(spark, monkeypatch, large, span, doubled):
    monkeypatch.setattr(prefix_trie, "LARGE", large)
    monkeypatch.setattr(prefix_trie, "SPAN", span)
    rows = conversations(large)
    frame = spark.createDataFrame([(*r, "more") for r in rows], "conv_id long, turn long, role string, text string, depth string").repartition(5)
    got = prefix_trie.prefix_trie(frame, doubled_up_to=doubled).collect()
    assert {tuple(r)[:-1] for r in got} == plain_trie(rows) and len(got) == len({(r.conv_id, r.depth) for r in got})
    assert sorted(r.position for r in got)[0] == 0 and next(r.depth for r in got if r.position == 0) == 0


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).count() == 0


def test_list_ranks_of_many_lists(spark):
    rng = random.Random(2)
    arcs, want = [], {}
    for n in (1, 2, 3, 50, 700):
        ids = [len(want) + i for i in range(n)]
        rng.shuffle(ids)
        want |= {a: n - i for i, a in enumerate(ids)}
        arcs += list(zip(ids, [*ids[1:], None], strict=True))
    frame = spark.createDataFrame(arcs, "arc long, next long").repartition(3)
    for limit in (10**6, 20):
        with scratch(spark) as keep:
            assert {r.arc: r["rank"] for r in prefix_trie.list_ranks(frame, keep, limit).collect()} == want


def test_hash_of_many_ids(spark):
    ids = {0: list(range(0, 30_000, 3)), 1: [5], 2: [-9000, -1, 0, 4095, 4096, 12_000]}
    frame = spark.createDataFrame([(k, i) for k, v in ids.items() for i in v], "k long, conv_id long").repartition(4)
    with scratch(spark) as keep:
        got = {r.k: r.ends_sha256 for r in prefix_trie.joined_hash(frame, ["k"], keep).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in ids.items()}
