"""Operator 11 against plain forward and Baum-Welch recursions over whole texts."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from loomspark.llm import hidden_markov as hm
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def random_model(rng, k, words):
    first, moves, emit = rng.random(k), rng.random((k, k)), rng.random((words, k)) * 0.1
    return first / first.sum(), moves / moves.sum(1, keepdims=True), emit


@pytest.mark.parametrize("sweep_size", [1 << 18, 3])
def test_sweeps_against_all_paths(monkeypatch, sweep_size):
    monkeypatch.setattr(hm, "SWEEP", sweep_size)
    rng = np.random.default_rng(1)
    first, moves, emit = random_model(rng, 3, 7)
    texts = [rng.integers(0, 7, n) for n in (1, 5, 2, 1, 6, 3)]
    lengths = np.array([len(t) for t in texts])
    packed = hm.Packed.of(np.concatenate(texts).astype(np.int32), lengths)
    logs = np.zeros(len(texts))
    for rows, scale in hm.sweep(packed, emit, first, moves):
        logs += np.bincount(packed.owner[rows], np.log(scale), len(texts))
    at = np.array([0, 1, 2, 3, 4, 0, 1])
    counts, pairs, starts = hm.expected(packed, emit, first, moves, at, 5)
    want = [np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)]
    for text, log in zip(texts, logs, strict=True):
        weights = {}
        for path in itertools.product(range(3), repeat=len(text)):
            p = first[path[0]] * emit[text[0], path[0]]
            for a, b, w in zip(path, path[1:], text[1:], strict=False):
                p *= moves[a, b] * emit[w, b]
            weights[path] = p
        total = sum(weights.values())
        assert log == pytest.approx(math.log(total))
        for path, p in weights.items():
            want[2][path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += p / total
            for s, w in zip(path, text, strict=True):
                want[0][at[w], s] += p / total
    for got, w in zip((counts, pairs, starts), want, strict=True):
        assert np.allclose(got, w)


def corpus():
    rng = random.Random(4)
    tongues = [[f"{t}{i}" for i in range(60)] for t in "abc"]
    texts = [" ".join(rng.choice(tongues[i % 3]) for _ in range(rng.randint(1, 60))) for i in range(90)]
    texts += [None, "", "  \n", "A1 a1\x0bÀ unseen\x00word", "b2 " * 9000, "once only words here", " ".join(a + b for a, b in zip(texts[0].split(), texts[1].split(), strict=False))]
    return [(i, t, float(i), "x") for i, t in enumerate(texts)] + [(3, texts[3], None, None)] * 3 + [(None, "a1 b2 c3", None, None)]


def tokens(t):
    return [*(w.lower() for w in WORD.findall((t or "").encode())), b""]


def plain_emission(word, c, n, v, ratios, own, k):
    """Probabilities of one word by state."""
    count = c.get(word, 0)
    if not count:
        return np.full(k, 0.5 / (n + 0.5 * (v + 1)))
    profile = word if count >= own else word[-2:]
    return (count * ratios[(count >= own, profile)] + 0.5) / (n + 0.5 * (v + 1))


@pytest.mark.parametrize("block_bytes", [1 << 24, 900])
def test_model_and_scores_against_plain_recursions(spark, monkeypatch, block_bytes):
    """Names of words stand in for their numbers: the profiles are told apart by the words that have them."""
    rows, own, k = corpus(), 6, 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, score double, tokens string").repartition(3)
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    seen, words = [], {}
    real, real_lexicon = hm.baum_welch, hm.lexicon

    def spy_lexicon(blocks, own):
        out = real_lexicon(blocks, own)
        listed = blocks.select("block", F.posexplode("words").alias("local", "word"))
        words.update({r.profile: bytes(r.word) for r in out.join(listed, ["block", "local"]).filter(F.col("c") >= own).select("profile", "word").distinct().collect()})
        return out

    def spy(coded, totals, model, keep):
        after = real(coded, totals, model, keep)
        seen.extend({r.profile: np.array(r.r) for r in m.ratios.collect()} for m in (model, after))
        return after

    monkeypatch.setattr(hm, "baum_welch", spy)
    monkeypatch.setattr(hm, "lexicon", spy_lexicon)
    told = []
    got = hm.language_model(frame, learn, carried=["doc_id", "tokens"], states=k, rounds=2, own=own, block_bytes=block_bytes, told=told).collect()
    held = {r.doc_id for r in frame.select("doc_id", (~learn).alias("h")).filter("h").collect()}
    texts = [(d, tokens(t)) for d, t, *_ in rows]
    c = Counter(w for d, t in texts if d not in held for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
    named = lambda found: {
        (True, words[p]) if p in words else (False, (lambda e: bytes([e >> 8, e & 255]) if e > 255 else bytes([e]) if e else b"")(-1 - p)): r for p, r in found.items()
    }

    def scored(t, model, ratios):
        a, log = None, 0.0
        for w in t:
            e = plain_emission(w, c, n, v, ratios, own, k)
            a = (model.first if a is None else a @ model.moves) * e
            log, a = log + math.log10(a.sum()), a / a.sum()
        return log

    final = named(seen[-1])
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "tokens", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    want = {d: t for d, t in texts}
    for r in got:
        t = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(base(t)) and r.score == pytest.approx(scored(t, told[-1], final), rel=1e-9)
    # each state's emissions are a distribution: all known words and the unknown one
    total = sum(plain_emission(w, c, n, v, final, own, k) for w in [*c, b"\x00none"])
    assert np.allclose(total, 1)
    # the second round, from the model of the first
    before, counts, pairs, starts = named(seen[2]), {}, np.zeros((k, k)), np.zeros(k)
    for d, t in texts:
        if d in held:
            continue
        e = [plain_emission(w, c, n, v, before, own, k) for w in t]
        fw, bw = [told[0].first * e[0]], [np.ones(k)]
        fw[0] /= fw[0].sum()
        scales = [1.0]
        for x in e[1:]:
            a = fw[-1] @ told[0].moves * x
            scales.append(a.sum())
            fw.append(a / a.sum())
        for x, s in zip(reversed(e[1:]), reversed(scales[1:]), strict=True):
            bw.append(told[0].moves @ (x * bw[-1]) / s)
        bw.reverse()
        starts += fw[0] * bw[0]
        for i, w in enumerate(t):
            key = (c[w] >= own, w if c[w] >= own else w[-2:])
            counts[key] = counts.get(key, 0) + fw[i] * bw[i]
            if i:
                pairs += np.outer(fw[i - 1], e[i] * bw[i] / scales[i]) * told[0].moves
    assert np.allclose(told[1].first, hm.from_counts(starts), atol=1e-4) and np.allclose(told[1].moves, hm.from_counts(pairs), atol=1e-4)
    share, totals = sum(counts.values()) / n, Counter()
    for w, m in c.items():
        totals[(m >= own, w if m >= own else w[-2:])] += m
    assert counts.keys() == final.keys()
    for key, found in counts.items():
        assert np.allclose(final[key], found / share / totals[key], rtol=2e-3, atol=2e-3)


def test_training_raises_the_likelihood_of_unseen_texts(spark):
    frame = spark.createDataFrame(corpus()[:90], "doc_id long, text string, a double, b string").repartition(2)
    learn = F.col("doc_id") % 5 != 1
    means = []
    for rounds in (0, 1, 3):
        out = hm.language_model(frame, learn, states=3, rounds=rounds, own=6).filter("held_out")
        means.append(out.agg(F.avg(F.col("score") - F.col("base_score"))).first()[0])
    assert 0 < means[1] <= means[2] + 0.1 and means[2] > 3  # three vocabularies: log10(3) a word


def test_scores_do_not_depend_on_the_layout(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, a double, b string").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    learn, results = F.col("doc_id") % 5 != 1, []
    for parts, size in ((1, 1 << 24), (4, 700)):
        out = hm.language_model(frame.repartition(parts, F.rand(parts)), learn, states=3, rounds=2, own=6, block_bytes=size).collect()
        results.append({r.doc_id: (r.base_score, r.score) for r in out})
    for d, (base, score) in results[0].items():
        assert results[1][d] == (pytest.approx(base), pytest.approx(score, rel=1e-4))


def test_nothing_to_learn_from_and_no_rows(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string, a double, b string")
    out = hm.language_model(frame, F.lit(False)).collect()
    assert all((r.base_score, r.n_known, r.train_tokens) == (0, 0, 0) and abs(r.score) < 1e-9 for r in out) and len(out) == len(corpus())
    assert hm.language_model(frame.limit(0), F.lit(True)).count() == 0
