"""Operators 2 to 10 against brute force on small fixtures with nulls, empties, ties and repeats."""

import difflib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from loomspark.llm import bpe, byte_cnn, jaccard_join, line_dedup, mixing, quality_rules, queries, sharding, shared, token_counts, url_filters, vector_dedup
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(17)


@pytest.fixture(autouse=True)
def own_generator(request):
    """Each test draws from its own sequence, whatever ran before it."""
    RNG.seed(request.node.name)


VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, vocabulary=VOCABULARY):
    return " ".join(RNG.choice(vocabulary) for _ in range(n))


def texts():
    base = [prose(RNG.randint(3, 120)) for _ in range(60)]
    out = base[:]
    for t in base[:25]:
        words = t.split(" ")
        for _ in range(RNG.randint(0, 3)):
            words[RNG.randrange(len(words))] = "changed"
        out.append(" ".join(words).upper())
    out += [base[0]] * 40 + [None, "", "   ", "one", "One", "a b c d", "é ü 東京", "x" * 40000, prose(30000, VOCABULARY[:5])]
    common = prose(60)
    out += [common + " " + prose(5) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    RNG.seed(17)
    rows = [(i, t, RNG.choice(["en", None]), RNG.choice(["a", "b", "c", None]), len(t or ""), "extra") for i, t in enumerate(texts())]
    rows.append(rows[3])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    for n, m in ((40, 25), (200, 150), (30, 200)):
        pairs = [(RNG.randrange(n), RNG.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(1000, 1030)]
        got = shared.connected_components(spark.createDataFrame([*pairs, (None, 1), (5, 5)], "src long, dst long"))
        want = components({x for p in pairs for x in p}, pairs)
        assert {r.node: r.component for r in got.collect()} == {x: want[x] for p in pairs for x in p if p[0] != p[1]}
    assert shared.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_url_rules_and_aliases(spark):
    canonical = '<link href="http://b.net/x" rel="canonical">'
    refresh = '<meta http-equiv="refresh" content="0; url=https://shop.example.com/de/9">'
    rows = [
        (1, "https://A.Example.ORG/es/1?q#f", ""), (2, "http://example.org/en/1", ""), (3, "http://x.com/fr/", ""), (4, "http://x.com/de", ""),
        (5, "http://xcom/fr/", ""), (6, "no scheme", None), (7, None, None), (8, "http://b.net/x", ""), (9, "http://c.net/y", canonical),
        (10, "http://b.net/x/?utm_a=1#z", refresh), (11, "http://d.net", ""), (11, "http://d.net", ""), (12, "http://e.net/1", '<link rel=canonical href="http://f.org/1">'),
        (13, "http://e.net/1?ref=q", '<link rel=canonical href="http://g.com/de/1">'), (14, "http://example.org", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.judge(df, spelling=True).collect()}
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("com/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow"),
            6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "block"), 10: (None, "block"), 11: (None, "allow"),
            12: (None, "allow"), 13: (None, "allow"), 14: (None, "allow")}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == want
    assert (got[1].host, got[1].path) == ("a.example.org", "/es/1") and (got[6].host, got[6].path) == ("", "")
    assert url_filters.judge(df).count() == len(rows) and url_filters.judge(df.limit(0)).count() == 0


def test_url_redirects_and_relative_links(spark):
    link = lambda x: f'<p>{"x" * 300000}</p><link rel="canonical" href="{x}">'
    rows = [
        (1, "http://a.com/de/1", ""), (2, "http://b.net/x/y/page", link("../../de/2?a=1&amp;b=2")), (3, "http://c.net/p", link("q")), (4, "http://d.net/a/", link("?s=1")),
        (5, "http://e.net/" + "z" * 20000, link("//a.com/de/1")), (6, "http://e.net/" + "z" * 20000 + ".html", ""), (7, "http://f.net/", link("")), (8, "http://g.net", link("mailto:x@y")),
        (9, None, link("http://a.com/de/1")), (10, "http://h.net/h", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.src[7:12]: r.dst for r in url_filters.html_links(df).collect()}
    assert found == {"b.net": "http://b.net/de/2?a=1&b=2", "c.net": "http://c.net/q", "d.net": "http://d.net/a/?s=1", "e.net": "http://a.com/de/1", "g.net": "mailto:x@y"}
    redirects = spark.createDataFrame([("http://b.net/de/2?a=1&b=2", "http://a.com/de/1"), ("http://h.net/h", "http://x.org/"), ("http://h.net/h", "http://c.com/de/"), (None, "http://x.org/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in url_filters.judge(df, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow"}
    assert url_filters.judge(df, redirects=redirects, spelling=True).filter("page_id = 6").first().verdict == "block"
    assert {r.page_id: r.group_pages for r in url_filters.judge(df, redirects=redirects).collect()} == {1: 3, 2: 3, 3: 1, 4: 1, 5: 3, 6: 1, 7: 1, 8: 1, 9: None, 10: 1}
    same = (("c.net", "", "allow"), ("net", "/p", "block"))  # equally long: the first counts
    assert url_filters.judge(df, rules=same).filter("page_id = 3").first().rule == "c.net"


def test_url_steps_up(spark):
    cases = {"../" * 9 + "top": "/top", "a/./b/../c": "/1/2/3/a/c", "..": "/1/2/", ".": "/1/2/3/", "../x/": "/1/2/x/", "a//b": "/1/2/3/a//b", "../y?q=../..#../z": "/1/2/y?q=../..#../z", "../../../../../../deep": "/deep"}
    rows = [(i, "http://h.net/1/2/3/page?x", f'<link rel="canonical" href="{link}">') for i, link in enumerate(cases)]
    found = url_filters.html_links(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.dst for r in found) == sorted("http://h.net" + want for want in cases.values())


def test_op2_follows_links_as_its_sql(spark, tmp_path):
    import duckdb

    link = lambda x: f'<link href="{x}" rel="canonical">'
    rows = [(1, "http://a.com/de/1", ""), (2, "http://b.net/x/page", link("/p?a=1&amp;b")), (3, "http://b.net/p?a=1&b", link("https://a.com/de/1")), (4, "http://c.net/p", link("q")), (5, "http://c.net/q", ""),
            (6, "http://c.net/q", '<META http-equiv=refresh content="0;URL=http://z.org/">'), (7, None, link("http://a.com/de/1")), (8, "http://d.net/", link("//a.com/de/1")), (9, "no", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLE_SQL["op2_url_filters"])
    got = queries.QUERIES["op2_url_filters"](spark, str(tmp_path)).select(*want.columns).collect()
    assert {tuple(r) for r in got} == set(want.fetchall()) and len(got) == 9
    assert {r.page_id: (r.verdict, r.group_pages) for r in got} == {1: ("block", 4), 2: ("block", 4), 3: ("block", 4), 4: ("allow", 3), 5: ("allow", 3), 6: ("allow", 3), 7: ("allow", None), 8: ("block", 4), 9: ("allow", None)}


def test_quality_rules(docs):
    extra = docs.sparkSession.createDataFrame(
        [(900, prose(60) + " the of and $$$ ***\n\n a\n a\nb"), (901, "the cat sat " * 30), (902, "a b a b a b")], "doc_id long, text string"
    )
    df = docs.select("doc_id", "text").unionByName(extra).withColumn("kept", F.lit("clash"))
    for r in quality_rules.apply_rules(df).join(df.select("doc_id", "text"), "doc_id").collect():
        t = r.text or ""
        words = WORD.findall(t)
        grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        inside = {i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        counts = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert r.kept == (not r.base_failed and not r.failed_rules)
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_sharding(docs, shards):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    some = docs.filter("length(text) < 2000 OR text IS NULL")
    rows = sharding.kd_shards(some, size, sharding.document_dimensions(size), shards=shards).collect()
    assert len(rows) == some.count()
    held, slots = Counter(), defaultdict(list)
    for r in rows:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(held) <= set(range(shards))
    whole, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert all(abs(held[s] - whole / shards) <= 3 * largest for s in range(shards))


def test_sharding_by_leaf_bytes_and_empty(spark, docs):
    size = F.lit(10).cast("long")
    rows = sharding.kd_shards(docs, size, sharding.document_dimensions(size), target_bytes=300).collect()
    held = Counter(r.shard for r in rows)
    assert max(held.values()) <= 31 and sum(held.values()) == docs.count()
    assert sharding.kd_shards(docs.limit(0), size, sharding.document_dimensions(size), shards=4).count() == 0


def test_shards_do_not_depend_on_the_layout(spark):
    rng = random.Random(3)
    rows = [(i, "long " * 4000 * (i % 50 == 0) + " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 30))), "en", rng.choice("ab")) for i in range(150)]
    rows += [(500, "the same", "en", "a")] * 40 + [(None, None, None, None)] * 3
    results = []
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts, F.rand(parts))
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
        placed = sharding.kd_shards(docs, size, sharding.document_dimensions(size), shards=4)
        results.append(sorted(placed.select("doc_id", "size", "shard", "slot").collect(), key=str))
    assert results[0] == results[1] and len({r.shard for r in results[0] if r.doc_id == 500}) <= 4


def test_split_points_against_a_sort(spark):
    """Widest dimension, and the weighted median of each node found by sorting all its rows."""
    rng = random.Random(23)
    whole = 1 << sharding.COORDINATE_BITS
    rows = []
    for i in range(900):
        node = i % 3
        a = rng.choice([5, 9, whole // 3]) if node == 0 else rng.randrange(whole // 2)  # node 0: ties in the dimension
        b = rng.randrange(whole) if node == 1 else 7
        rows.append((i, rng.choice([0, 1, 5, 5, 40, 3000]) if node else 1, rng.choice([3, rng.randrange(1 << 30)]), a, b, node))
    rows += [(1000 + i, 1, 3, 5, 7, 0) for i in range(20)]  # rows that nothing tells apart
    base = spark.createDataFrame(rows, "_row long, size long, tie long, q_a long, q_b long, node int")
    shards = {0: 2, 1: 3, 2: 5, 9: 4}
    points = sharding._split_points(base, shards, ["q_a", "q_b"])
    assert set(points) == {0, 1, 2}
    for node, (dim, at) in points.items():
        mine = [r for r in rows if r[5] == node]
        widths = [max(r[k] for r in mine) - min(r[k] for r in mine) for k in (3, 4)]
        assert dim == widths.index(max(widths))
        sizes = Counter()
        for r in mine:
            sizes[r[3 + dim] << (sharding.ROUND_BITS * sharding.ROUNDS - sharding.COORDINATE_BITS) | r[2]] += r[1]
        goal, upto, left = sum(sizes.values()) * (shards[node] // 2) / shards[node], 0, set()
        for key in sorted(sizes):
            if upto + sizes[key] < goal or (upto < goal <= upto + sizes[key] and 2 * (goal - upto) >= sizes[key]):
                left.add(key)
            upto += sizes[key]
        assert {key for key in sizes if key < at} - left == set() and {k for k in left - {k for k in sizes if k < at} if sizes[k]} == set()


@pytest.mark.parametrize("rule", token_counts.BOUNDARY_RULES)
def test_token_counts(spark, docs, rule):
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    rows = [(0, "one\n\n\ntwo three\n"), (1, "é\n東京\n🙂🙂 x"), (2, ""), (3, None), (4, "\n \n"), (5, "a\r\nb  \n  c")]
    rows += [(10 + i, t) for i, t in enumerate(texts()) if t]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("section", F.lit("clash"))
    twice = token_counts.attribute(token_counts.line_sections(df.union(df.filter("doc_id = 1"))).withColumn("n_tokens", F.lit(0)), rule)
    assert twice.filter("doc_id = 1").count() == 6 and twice.dropDuplicates().filter("doc_id = 1").count() == 3
    assert token_counts.attribute(token_counts.line_sections(df.limit(0)), rule).count() == 0
    none = df.filter("doc_id < 2").withColumn("section_lengths", F.when(F.col("doc_id") == 0, F.array(F.lit(4), F.lit(99))).otherwise(F.array().cast("array<int>")))
    assert [(r.section, r.n_chars) for r in token_counts.attribute(none, rule).orderBy("section").collect()] == [(0, 4), (1, 12)]
    got = defaultdict(dict)
    for r in token_counts.attribute(token_counts.line_sections(df), rule).collect():
        got[r.doc_id][r.section] = (r.n_chars, r.n_tokens, r.n_crossing)
    for i, t in rows:
        if t is None:
            assert i not in got
            continue
        lines = [x + "\n" for x in t.split("\n")[:-1]] + [t.split("\n")[-1]]
        owner = [k for k, x in enumerate(lines) for _ in x.encode()]
        count, crossing, at = Counter(), Counter(), 0
        for token in library.encode_ordinary(t):
            n = len(library.decode_single_token_bytes(token))
            parts = Counter(owner[at : at + n])
            at += n
            for k, c in parts.items():
                crossing[k] += len(parts) > 1
                if rule == "share":
                    count[k] += c / n
            if rule != "share":
                count[min(parts) if rule == "first" else max(parts, key=lambda k: (parts[k], -k))] += 1  # noqa: B023
        want = {k: (len(x), pytest.approx(count[k]), crossing[k]) for k, x in enumerate(lines)}
        assert got[i] == want, (i, t)


def test_field_sections(spark):
    df = spark.createDataFrame([(1, "the title", "a body"), (2, None, "x")], "id long, title string, body string")
    rows = token_counts.attribute(token_counts.field_sections(df, ["title", "body"])).orderBy("id", "section").collect()
    assert [(r.id, r.section, r.n_chars) for r in rows] == [(1, 0, 10), (1, 1, 6), (2, 0, 1), (2, 1, 1)]


def test_byte_cnn(spark):
    good = ["the house and the garden are quiet " * RNG.randint(1, 40) for _ in range(150)]
    bad = [" ".join(RNG.choice(["xq%%%", "zv$$$", "###"]) for _ in range(RNG.randint(5, 200))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate([x for p in zip(good, bad, strict=True) for x in p])]
    df = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i, _ in rows] + [(5000, None, 0)], "doc_id long, quality int, toxic int")
    net = byte_cnn.fit(df, labels, epochs=4)
    got = byte_cnn.score(df, net).withColumn("held_out", byte_cnn.held_out()).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id < 1000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in held) >= 0.95 * len(held)
    none = byte_cnn.fit(df, labels.limit(0))
    assert {r.predicted for r in byte_cnn.score(df, none).collect()} == {1}


def test_byte_cnn_reads_the_whole_text():
    net = byte_cnn.train(["abc " * 50, "%%% " * 50] * 20, [1, 0] * 20, epochs=3)
    long = "abc " * 20000
    assert net.score([long])[0] > net.score([long[:-40] + "%%% " * 10])[0]
    for n in (0, 1, 4, 5, 252, 256, 257, 508, 509):
        parts = byte_cnn.chunks(bytes(range(1, 251)) * 3 if n > 750 else bytes([7]) * n)
        assert sum(int((p != 0).sum()) for p in parts) >= n and parts.shape[1] == byte_cnn.CHUNK


def plain_features(net, text):
    """Mean and maximum over chunks of the largest response of each filter, one product after another."""
    data, stride = text.encode(), byte_cnn.CHUNK - byte_cnn.WIDTH + 1
    tops = []
    for start in range(0, max(len(data) - byte_cnn.WIDTH + 1, 1), stride):
        part = data[start : start + byte_cnn.CHUNK]
        part += bytes(byte_cnn.CHUNK - len(part))
        ends = range(byte_cnn.CHUNK - byte_cnn.WIDTH + 1)
        tops.append([
            max(0.0, net.bias[f] + max(sum(float(net.filters[k, part[i + k], f]) for k in range(byte_cnn.WIDTH)) for i in ends))
            for f in range(byte_cnn.FILTERS)
        ])
    return [sum(c) / len(tops) for c in zip(*tops, strict=True)] + [max(c) for c in zip(*tops, strict=True)]


def test_byte_cnn_against_a_plain_convolution():
    net = byte_cnn.train(["abc é " * 50, "%%% 7" * 60] * 10, [1, 0] * 10, epochs=2)
    cases = ["", "a", "abcd", "é東京", "x" * 252, "x" * 256 + "y", prose(60), prose(150), "%%% abc"]
    got = net.score([*cases, None])
    for text, score in zip([*cases, ""], got, strict=True):
        z = sum(w * x for w, x in zip(net.weights.tolist(), plain_features(net, text), strict=True)) + net.intercept
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


@pytest.mark.parametrize("seed", range(12))
def test_byte_cnn_learns_down_the_gradient(seed):
    """The first step of training moves each weight against the sign of a numeric gradient of the loss.

    Weights at which a maximum changes hands between the two sides have no slope there and are passed over:
    for them a step of half the size gives another slope.
    """
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    # repeated phrases: their chunks tie for the maximum
    texts, labels = [words(70), "%%% $$$ " * 300, words(20), "### 12 " * 150], [1, 0, 1, 0]
    start, after = byte_cnn.train(texts, labels, epochs=1, rate=0.0), byte_cnn.train(texts, labels, epochs=1, rate=1e-3)

    def loss():
        p = np.clip(start.score(texts), 1e-9, 1 - 1e-9)
        return -np.mean(np.where(np.array(labels) == 1, np.log(p), np.log(1 - p)))

    def slope(flat, i, step):
        kept, sides = flat[i], []
        for by in (step, -step):
            flat[i] = kept + by
            sides.append(loss())
        flat[i] = kept
        return (sides[0] - sides[1]) / (2 * step)

    checked = 0
    for values, moved in ((start.filters, after.filters), (start.bias, after.bias), (start.weights, after.weights)):
        flat, where = values.reshape(-1), np.abs((moved - values).reshape(-1))
        for i in np.flatnonzero(where > 0)[:: max(1, int((where > 0).sum()) // 25)]:
            wide, narrow = slope(flat, i, 1e-3), slope(flat, i, 5e-4)
            if abs(wide) > 1e-3 and abs(wide - narrow) < 0.05 * abs(wide):
                checked += 1
                assert np.sign(moved.reshape(-1)[i] - flat[i]) == -np.sign(wide)
    assert checked >= 15


def test_vector_dedup(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    rows = []
    for i in range(900):
        v = centres[rng.integers(30)] + rng.standard_normal(16) * rng.choice([0.0, 0.2, 0.35])
        rows.append((i, [float(x) for x in v], int(rng.integers(2)) if i % 50 else None))
    odd = [[], None, [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash"))
    usable = [(i, np.array(np.float32(v), float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for k, (i, v, y) in enumerate(usable):
        for j, w, z in usable[:k]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links.append((i, j))
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df).collect()}
    degree = Counter(x for p in links for x in p)
    assert len(got) == len(rows)
    assert all(got[i].n_links <= degree[i] for i, *_ in rows)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(degree.values())
    assert sum(got[i].component_id == c for i, c in components([r[0] for r in rows], links).items()) >= 0.99 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_extreme_length_and_wrong_ids(spark):
    rows = [(1, "a", [1e-170, 2e-170]), (2, "a", [1e-170, 2e-170]), (3, "a", [1e160, 2e160]), (4, "a", [-1e160, 2e160]), (5, "b", [5e-324, 0.0]), (6, "b", [1e308, 1.0]), (7, "b", [0.0, 0.0]), (8, "b", [1.0, float("inf")])]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}
    with pytest.raises(ValueError):
        vector_dedup.near_duplicates(df.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_recall_of_pairs_near_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows, pairs = [], {}
    for i in range(400):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cosine = (0.9300001, 0.935, 0.94, 0.95)[i % 4]
        pairs.setdefault(cosine, []).append(2 * i)
        rows += [(2 * i, "x", a.tolist()), (2 * i + 1, "x", (cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)).tolist())]
    rows += [(10_000 + i, "x", v.tolist()) for i, v in enumerate(rng.standard_normal((2000, 64)))]
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    for cosine, ids in pairs.items():
        assert sum(got[i] == 1 for i in ids) >= (0.93 if cosine < 0.931 else 0.97) * len(ids)
    assert all(got[i] == 0 for i in got if i >= 10_000)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 64))
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    found, errors = [], []
    for seed in range(400):
        turned = vector_dedup.rotations(64, 2, seed)
        signs, factors = vector_dedup.encode(a[None] @ turned, 64)
        about, error = vector_dedup.estimate(signs, factors, b[None] @ turned)
        found.append(about[0, 0])
        errors.append(error[0])
    assert abs(np.mean(found) - a @ b) < 0.02
    assert np.mean(np.abs(np.array(found) - a @ b) <= 3 * np.array(errors)) > 0.98


def test_tiles_of_a_large_band(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.ones(8) + rng.standard_normal(8) * 0.05], 1) for i in range(120)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links == 119 and r.component_id == 0 for r in got)


def lines_of(n, tag=""):
    return [f"{tag} {prose(6)} line {RNG.random()}" for _ in range(n)]


def test_patience_alignment():
    for _ in range(300):
        a = [RNG.randrange(12) for _ in range(RNG.randint(0, 15))]
        b = a[:] if RNG.random() < 0.3 else [RNG.randrange(12) for _ in range(RNG.randint(0, 15))]
        hit = line_dedup.aligned(a, b)
        at = 0
        for i in hit:  # an aligned line list is a common subsequence
            at = b.index(a[i], at) + 1
        if a == b:
            assert hit == list(range(len(a)))
    unique = list(range(20))
    moved = unique[10:] + unique[:10]
    assert len(line_dedup.aligned(unique, moved)) == max(m.size for m in difflib.SequenceMatcher(None, unique, moved).get_matching_blocks())


def test_line_dedup(spark):
    passage, boiler = lines_of(3, "p"), lines_of(1, "boiler plate of more than eight words in one line")
    rows = [(i, "\n".join(lines_of(4) + (boiler if i % 2 else []) + lines_of(2))) for i in range(40)]
    rows += [(100, "\n".join(lines_of(3) + passage)), (101, "\n".join(passage + lines_of(2))), (102, "\n".join(lines_of(1) + ["  " + p + " " for p in passage]))]
    rows += [(200, rows[0][1]), (201, "ok\nfine"), (202, "ok\nfine"), (203, None), (204, ""), (205, "\n\n"), (200, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    first, want = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        keep, n = [], 0
        for line in (t or "").split("\n"):
            key = line.strip()
            if len(key.split()) >= 8 and first.setdefault(key, i) != i:
                n += 1
            else:
                keep.append(line)
        want[i] = ("\n".join(keep) if t is not None else None, n)
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text, r.n_deleted) == (want[r.doc_id] if r.doc_id is not None else (rows[0][1], 0)), r.doc_id
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_common_subsequence(monkeypatch):
    for bits in (line_dedup.TABLE_BITS, 40):  # whole and halved
        monkeypatch.setattr(line_dedup, "TABLE_BITS", bits)
        for _ in range(200):
            a, b = ([RNG.randrange(5) for _ in range(RNG.randint(0, 14))] for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            got = line_dedup.common_subsequence(a, b)
            assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_line_dedup_crossed_and_repeated(spark):
    p, q, (x,), (y,) = lines_of(2, "p"), lines_of(2, "q"), lines_of(1, "x"), lines_of(1, "y")
    rows = [(0, q + p), (1, p + q), (2, p + q), (3, p + q)]  # 1 crosses its only earlier holder
    rows += [(10, [x]), (11, [x] * 6), (12, [x] * 6), (13, [y, x])]  # repeated; 11 has one line to align with
    rows += [(20, [x, y, x, y]), (21, [y, x, y, x])]
    rows += [(30 + i, [f"{x} again"]) for i in range(9)] + [(40, [f"{x} again"] * 9)]  # one line from each of nine holders
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_deleted for r in line_dedup.dedup_lines(df).collect()}
    assert [got[i] for i in range(4)] == [0, 2, 4, 4]
    assert [got[i] for i in (10, 11, 12, 13)] == [0, 1, 6, 1]
    assert (got[20], got[21]) == (3, 4)
    assert [got[i] for i in (30, 31, 38, 40)] == [0, 1, 1, 9]


def test_line_dedup_blocks_of_one_partner(spark):
    """Short lines count only together, and only where one earlier document has them together."""
    rows = [(10, "one two three four\nmine is ten"), (11, "five six seven eight\nmine is eleven"), (12, "one two three four\nfive six seven eight")]
    rows += [(20, "a b c\nd e f\ng h i\nj k l\nown"), (21, "x y\na b c\nd e f\ng h i\nz z"), (22, "g h i\nj k l\na b c\nd e f")]
    long = " ".join(f"w{i}" for i in range(12))
    rows += [(30, f"title\n{long}\nend\nrest"), (31, f"title\n{long}\nend"), (32, f"other\n{long}\nend"), (33, f"title\n{long}\nfin")]
    rows += [(40, "\n".join(lines_of(3, "t"))), (41, "é " * 9 + "\n" + " ".join(["x"] * 100000)), (42, "y\n" + " ".join(["x"] * 100000))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    same = (10, 11, 12, 20, 22, 30, 40, 41)
    assert {i: got[i] for i in same} == {i: t for i, t in rows if i in same}
    assert (got[21], got[31], got[32], got[33], got[42]) == ("x y\nz z", "", "other", "fin", "y")


def test_least_blocks_cover_common_blocks():
    rng = random.Random(31)
    for _ in range(3000):
        a, b = ([" ".join("v" for _ in range(rng.randint(0, 4))) + rng.choice("pq") for _ in range(rng.randint(1, 9))] for _ in "ab")
        parts = [defaultdict(list), defaultdict(list)]  # a text may have a block at several places
        for x, places in zip((a, b), parts, strict=True):
            for first, last, key in line_dedup.least_blocks("\n".join(x), 6):
                places[key].append((first, last))
        hit = {i for key in parts[0].keys() & parts[1].keys() for first, last in parts[0][key] for i in range(first, last + 1)}
        want, size = set(), lambda x: sum(len(t.split()) for t in x)
        for i in range(len(a)):
            for j in range(i + 1, len(a) + 1):
                if size(a[i:j]) >= 6 and any(b[k : k + j - i] == a[i:j] for k in range(len(b))):
                    want |= set(range(i, j))
        assert hit == want


def test_line_dedup_rows_of_one_id(spark):
    p, q, r = lines_of(2, "p"), lines_of(2, "q"), lines_of(2, "r")
    rows = [(1, p + q), (2, q + r), (2, r + q), (2, p + r), (2, p + r)]
    df = spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], "doc_id long, text string")
    got = sorted(t.text for t in line_dedup.dedup_lines(df).collect() if t.doc_id == 2)
    assert got == ["\n".join(r)] * 4


def test_line_dedup_blank_lines(spark):
    verse = "\n\n".join(f"verse {i} of the song" for i in range(12))
    rows = [(1, f"start\n\n{verse}\n\nend"), (2, f"other\n\n{verse.replace(chr(10) * 2, chr(10) + '  ' + chr(10) * 2)}\n\nlast")]
    rows += [(3, f"{verse}\nbetween\n{verse}"), (4, "verse 1 of the song\n\nmine\n\nverse 2 of the song")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0)
    assert got[2] == ("other\n\n\nlast", 12 + 11 * 2)
    assert got[3] == (f"between\n{verse}", 23) or got[3] == (f"{verse}\nbetween", 23) or got[3] == ("between", 46)
    assert got[4] == (rows[3][1], 0)


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken in (0, r.size, 2 * r.size)
        assert len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    # targets by repeated resharing
    sources = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    left, open_, want = 1.5 * sum(sizes.values()), set(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2.0 * sizes[s] if full else share[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert target == {s: pytest.approx(want[s]) for s in sources}
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in sources)
    ordered = mixing.in_training_order(mixing.mix(docs)).select("position").collect()
    assert [r.position for r in ordered] == sorted(r.position for r in ordered)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_inversion(spark):
    for k, schedule in enumerate(mixing.SCHEDULES):
        share = np.linspace(0, 1, 21)
        df = spark.createDataFrame([(float(s), k) for s in share], "s double, k int")
        times = [r[0] for r in df.orderBy("s").select(mixing.time_of(F.col("s"), F.col("k"))).collect()]
        fine = np.linspace(0, 1, 20001)
        w = np.interp(fine, *zip(*schedule, strict=True))
        done = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        assert np.allclose(np.interp(times, fine, done / done[-1]), share, atol=1e-4)


def shingles(t):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_jaccard_join(docs):
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    pairs = [(a, b) for a in rows for b in rows if a < b and rows[a] and rows[b] and 100 * len(rows[a] & rows[b]) >= 75 * len(rows[a] | rows[b])]
    want = components(rows, pairs)
    got = jaccard_join.similar_documents(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(rows[i]), want[i]) for i in rows}
    assert {r.doc_id for r in jaccard_join.keep_first(docs).collect()} == {i for i in rows if want[i] == i}
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0


def test_jaccard_join_at_the_threshold_and_in_chains(spark):
    """Random sets near the threshold, of sizes at the ratio's edge, with shared passages."""
    rows, vocabulary = [], [f"v{i}" for i in range(5000)]
    for g in range(40):
        n = RNG.randint(5, 60)
        base = [RNG.choice(vocabulary) for _ in range(n)]
        for _ in range(6):
            cut = RNG.randint(0, max(1, n // 4))
            words = base[cut:] if RNG.random() < 0.5 else base[: n - cut] + [RNG.choice(vocabulary) for _ in range(RNG.randint(0, 4))]
            rows.append((len(rows), " ".join(words)))
    RNG.shuffle(rows)
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, pairs)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("rows_of_block", [512, 4])
def test_components_without_counts_are_the_same(spark, docs, monkeypatch, rows_of_block):
    """Groups of near copies, members that only other members link with, chains, and the shared fixture."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows_of_block)
    made = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(60)]
        for k in range(25):
            own = words[:]
            for _ in range(k % 7):
                own[RNG.randrange(60)] = f"x{RNG.randrange(4)}"
            made.append(" ".join(own[: 60 - k % 4]))
        chain = [f"g{g}c{i}" for i in range(90)]
        made += [" ".join(chain[4 * k : 4 * k + 50]) for k in range(10)]
    rows = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    full = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(rows).collect()}
    few = jaccard_join.similar_documents(rows, count_links=False).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in few} == full and {r.n_links for r in few} == {None}


def test_jaccard_links(spark, docs):
    def shingles(text):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))

    sets = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    alike = lambda x, y: bool(x) and 100 * len(x & y) >= 75 * len(x | y)
    counts = sorted((i, sum(alike(x, y) for _, y in sets) - bool(x)) for i, x in sets)
    assert sorted((r.doc_id, r.n_links) for r in jaccard_join.similar_documents(docs).collect()) == counts
    rep = {}
    for i, x in sets:
        rep[x] = min(i, rep.get(x, i))
    want = sorted((i, j) for x, i in rep.items() for y, j in rep.items() if i < j and alike(x, y))
    assert len(want) > 20 and sorted(map(tuple, jaccard_join.links(docs).collect())) == want
    assert jaccard_join.links(docs.limit(0)).count() == 0


def test_jaccard_tiles_of_one_pivot(spark, monkeypatch):
    """A group of near copies over many blocks: links and components from differences, some read, some not."""
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    base, rows = [f"b{i}" for i in range(150)], []
    for i in range(70):
        words = base[:]
        for _ in range(RNG.randint(0, 7)):
            words[RNG.randrange(150)] = f"n{RNG.randrange(400)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    pairs = sorted((i, j) for i in sets for j in sets if i < j and sets[i] != sets[j] and alike(sets[i], sets[j]))
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: sum(alike(sets[i], sets[j]) for j in sets if j != i) for i in sets}
    assert {r.doc_id: r.component_id for r in got} == components(sets, [(i, j) for i in sets for j in sets if i < j and alike(sets[i], sets[j])])
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(frozenset(s), i)
    want = sorted((i, j) for i, j in pairs if first[frozenset(sets[i])] == i and first[frozenset(sets[j])] == j)
    assert sorted(map(tuple, jaccard_join.links(spark.createDataFrame(rows, "doc_id int, text string")).collect())) == want


def test_keep_first_null_and_repeated_ids(spark):
    a, b, c = prose(60), prose(60), prose(60)
    near = " ".join([*a.split(" ")[:-1], "changed"])
    rows = [(1, a), (1, a), (1, near), (1, b), (2, a), (3, b), (4, c), (4, c), (5, c), (None, a), (None, c)]
    got = jaccard_join.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    ids = sorted(-1 if r.doc_id is None else r.doc_id for r in got)
    assert ids == [-1, -1, 1, 1, 4] and {r.text for r in got if r.doc_id == 4} == {c}
    assert len({r.text for r in got if r.doc_id == 1} & {a, near}) == 1 and b in {r.text for r in got}


def test_op9_follows_the_curriculum(spark, docs, tmp_path, monkeypatch):
    docs.filter("doc_id IS NOT NULL").write.parquet(f"{tmp_path}/documents.parquet")
    orders = []
    for schedules in (mixing.SCHEDULES, ((((0.0, 0.1), (1.0, 1.9)),) + mixing.SCHEDULES[1:])):
        mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/documents.parquet"), schedules=schedules)
        with monkeypatch.context() as m:
            m.setattr(mixing, "mix", lambda _, mixed=mixed, **__: mixed)
            got = queries.op9_source_mix(spark, str(tmp_path)).collect()
        want = sorted(mixed.collect(), key=lambda r: (min(r.positions, default=2.0), r.doc_id))
        columns = ("doc_id", "size", "source_size", "target", "taken", "copies")
        assert [tuple(r)[:6] for r in got] == [tuple(r[c] for c in columns) for r in want]
        assert [(r.first_position, r.last_position) for r in got] == [(min(r.positions, default=None), max(r.positions, default=None)) for r in want]
        again = queries.op9_source_mix(spark, str(tmp_path)).collect() if schedules is mixing.SCHEDULES else got
        assert again == got  # reruns agree
        orders.append([r.doc_id for r in got])
    assert orders[0] != orders[1] and sorted(orders[0]) == sorted(orders[1])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = ["\n".join(f"the {w} and the {v} of it are in this house" for w, v in zip(prose(6).split(), prose(6).split(), strict=True)) for _ in range(60)]
    bad = [" ".join("xq%%%" for _ in range(80)) for _ in range(30)]
    near = good[0].replace("house", "garden", 1)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate([*good, near, good[1], *bad])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int("%%%" not in t), 0) for i, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == set(range(62)) and kept.columns == docs.columns
    deduped = corpus_pipeline.lines(spark, kept, str(tmp_path)).collect()
    assert {r.doc_id for r in deduped} == set(range(62)) - {61}
    assert all(r.n_chars == len(r.text) for r in deduped)
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} <= set(range(61)) and all(r.n_tokens == len(r.ids) for r in final)
    text = {r.doc_id: r.text for r in deduped}
    own = bpe.ByteBpe(bpe.load_ranks(bpe.default_vocabulary()[0]), bpe.default_vocabulary()[1])
    assert all(r.ids == own.encode(text[r.doc_id]) for r in final)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Clashing columns, null and empty texts, null and repeated ids; each stage against a plain version."""
    import corpus_pipeline

    good = ["\n".join(f"the {w} and the {v} of it are in this house {i}" for w, v in zip(prose(5).split(), prose(5).split(), strict=True)) for i in range(40)]
    bad = [" ".join("xq%%%" for _ in range(80)) for _ in range(20)]
    long = prose(30000) + "\n" + good[3]
    rows = [(i, t, "en", f"s{i % 3}", len(t), i, -1.5, "p", "kept") for i, t in enumerate([*good, good[0].replace("house", "garden", 1), long, *bad])]
    rows += [(900, None, None, None, None, 1, 0.0, "p", "kept"), (901, "", "en", "s0", 0, 1, 0.0, "p", "kept"), (None, good[5], "en", "s1", 9, 1, 0.0, "p", "kept"), rows[7], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, Score double, position string, n_lines string"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], int("%%%" not in r[1]), 0) for r in rows if r[0] is not None and r[1]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stages[name], before = kept.collect(), kept
        kept = shared.materialise(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns and {r.n_lines for r in kept.collect()} == {"kept"}, name
        assert stage(spark, shared.materialise(before.limit(0)), str(tmp_path)).count() == 0 or name == corpus_pipeline.STAGES[0][0]
    assert not any("%%%" in (r.text or "") for r in stages["line dedup"]) and len(stages["line dedup"]) >= 44
    inside = stages["n-gram Jaccard join"]
    assert sum(r.doc_id == 7 for r in inside) == 3 and any(r.doc_id is None and r.text == good[5] for r in inside)
    mixed_in = stages["mixing sources to target weights"]
    sets = [(r, shingles(r.text)) for r in inside]
    for r, s in sets:  # one row stays for each text that nothing links with, null ids stay
        alone = r.doc_id is None or not any(o is not r and o.doc_id is not None and s and x and 100 * len(s & x) >= 75 * len(s | x) for o, x in sets)
        assert not alone or r in mixed_in
    assert sum(r.doc_id == 7 for r in mixed_in) == 1
    final = corpus_pipeline.tokens(spark, kept, str(tmp_path)).collect()
    assert [(r.file, r.row) for r in final] == sorted((r.file, r.row) for r in final)  # training order, and every copy
    copies = Counter()
    for r in mixing.mix(spark.createDataFrame(mixed_in, schema)).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in final) == +copies
