"""Operator 11: a hidden Markov language model of words.

Latent states emit the words of a text, one after another, and an end. Baum-Welch: every training text is
swept forward and backward under the model so far, the expected counts of states, transitions and words are
added up over all partitions, and their ratios are the next model. The scaled forward recursion then gives
the exact likelihood of any text.

Texts are encoded once, in blocks of some MB, and a block only ever needs the emissions of its own words:
the table of words is joined to blocks by shuffles and never sent whole to a task or the driver. Words that
are at least OWN of all training tokens have an emission profile of their own; rarer ones share the profile
of their last two bytes. So there are 1 / OWN + 65,536 profiles at most, while every word is counted. With profile r, states' shares s, c occurrences in N training tokens and V distinct
ones, state k emits a word with probability (c * r_k + 0.5) / (N + 0.5 * (V + 1)): mixed by their shares the
states give the unigram estimate of the base score, and an unknown word has the same mass in each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.shared import bucketed, materialise, release, scratch, slices

STATES, ROUNDS, OWN = 6, 2, 5e-6
#: Occurrences that a profile of its own needs in a small corpus.
LEAST = 20
#: Bytes of text a block has at most (a longer text is a block), and words swept at a time.
BLOCK_BYTES, SWEEP = 8 << 20, 1 << 17
#: Texts, of at most so many bytes, from which the first guess of the states is taken; the driver reads them.
SEEDS, SEED_BYTES = 384, 16_000
#: Rounds over these texts, and what a state that a profile was not seen in keeps of the unigram estimate.
SEED_ROUNDS, CAUTION = 8, 2.0
#: Names of what is counted beside profiles: transitions from state k at TRANSITIONS + k, first states at FIRST.
TRANSITIONS, FIRST = -(1 << 62), -(1 << 61)
Keep = Callable[[DataFrame], DataFrame]


def encoded(docs: DataFrame, carried: list[str], block_bytes: int) -> DataFrame:
    """One row a block: the carried columns, flags and lengths of its documents, their words as places in its
    own word list (END, the empty word, behind each text), and how often training texts have each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 24, 0
        words: dict[bytes, int] = {}
        parts, lengths, rows = [], [], []

        def block() -> pa.RecordBatch:
            nonlocal number
            tokens, size = np.concatenate(parts), np.concatenate(lengths)
            whole = pa.Table.from_batches(rows).combine_chunks()
            learn = np.repeat(whole.column("_learn").to_numpy(zero_copy_only=False), size)
            trained = np.bincount(tokens[learn], minlength=len(words))
            listed = [
                pa.ListArray.from_arrays(pa.array([0, whole.num_rows], pa.int32()), whole.column(c).combine_chunks())
                for c in [*carried, "_learn", "_seed"]
            ]
            number += 1
            made = [
                pa.array([number], pa.int64()), *listed, pa.array([size.astype("<i4").tobytes()], pa.binary()), pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(list(words), pa.binary())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(trained.astype(np.int64))),
            ]
            out = pa.RecordBatch.from_arrays(made, ["block", *carried, "_learn", "_seed", "lengths", "tokens", "words", "trained"])
            words.clear(), parts.clear(), lengths.clear(), rows.clear()
            pa.default_memory_pool().release_unused()
            return out

        for batch in batches:
            for part in slices(batch, "_text"):
                flat: list[bytes] = []
                size = []
                for t in part.column("_text").cast(pa.binary()).to_pylist():
                    own = t.lower().split() if t else []
                    flat += own
                    flat.append(b"")
                    size.append(len(own) + 1)
                    held += len(t or b"") + 16
                coded = pa.array(flat, pa.binary()).dictionary_encode()
                place = np.fromiter((words.setdefault(w, len(words)) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
                parts.append(place[coded.indices.to_numpy()])
                lengths.append(np.array(size, np.int32))
                rows.append(part.select([*carried, "_learn", "_seed"]))
                if held >= block_bytes:
                    yield block()
                    held = 0
        if rows:
            yield block()

    kinds = [f"`{c}` array<{docs.schema[c].dataType.simpleString()}>" for c in carried]
    schema = ", ".join(["block long", *kinds, "_learn array<boolean>", "_seed array<long>", "lengths binary", "tokens binary", "words array<binary>", "trained array<long>"])
    return docs.mapInArrow(run, schema)


def lexicon(blocks: DataFrame, own: int) -> DataFrame:
    """(block, local, c, profile, first, trained) for each word of each block: c counts it in all training texts.

    A profile is a hash of a word, not below 0, or -1 less the last two bytes of a rarer one; words that no
    training text has share one. Should two words share a hash, they share a profile. first marks one row of
    each word.
    """
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("local", "w"))
    pairs = pairs.select("block", "local", "w.words", "w.trained", (F.shiftleft("block", 24) + F.col("local")).alias("_id"))
    same = Window.partitionBy("words")
    pairs = pairs.withColumns({"c": F.sum("trained").over(same), "_word": F.min("_id").over(same)})
    ending = F.coalesce(F.conv(F.hex(F.substring("words", -2, 2)), 16, 10).cast("long"), F.lit(0))
    number = F.shiftrightunsigned(F.xxhash64("words"), 2)  # of the word alone: files and blocks do not decide
    profile = F.when(F.col("c") >= own, number).when(F.col("c") > 0, -1 - ending).otherwise(F.lit(-1))
    return pairs.select("block", "local", "c", profile.alias("profile"), (F.col("_id") == F.col("_word")).alias("first"), "trained")


def recoded(blocks: DataFrame, words: DataFrame, carried: list[str]) -> DataFrame:
    """``blocks`` with their tokens as places in a list of entries (count, profile), which rare words share."""
    kept = [*carried, "_learn", "_seed"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        local = right.column("local").to_numpy()
        both = np.empty((len(local), 2), np.int64)
        both[local, 0], both[local, 1] = right.column("c").to_numpy(), right.column("profile").to_numpy()
        both[both[:, 0] == 0, 1] = -1
        order = np.lexsort((both[:, 0], both[:, 1]))
        ordered = both[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
        entry = np.empty(len(order), np.int32)
        entry[order] = np.cumsum(fresh) - 1
        entries = ordered[fresh]
        profiles, at = np.unique(entries[:, 1], return_inverse=True)
        tokens = entry[np.frombuffer(left.column("tokens")[0].as_py(), "<i4")]
        made = [
            pa.array([tokens.astype("<i4").tobytes()], pa.binary()), pa.array([entries[:, 0].astype("<i8").tobytes()], pa.binary()),
            pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(profiles)], pa.int32()), pa.array(profiles)),
        ]
        table = left.select(["block", *kept, "lengths"])
        for name, column in zip(["tokens", "counts", "at", "profiles"], made, strict=True):
            table = table.append_column(name, column)
        return table

    left = blocks.select("block", *(f"`{c}`" for c in kept), "lengths", "tokens")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields] + ["counts binary", "at binary", "profiles array<long>"])
    return left.groupBy("block").cogroup(words.select("block", "local", "c", "profile").groupBy("block")).applyInArrow(run, schema)


@dataclass
class Packed:
    """Sequences laid out step by step, the longest first: step t has the t-th word of all that have one."""

    tokens: np.ndarray
    owner: np.ndarray  # the sequence of each token
    offset: np.ndarray  # (steps + 1,): where each step begins

    @classmethod
    def of(cls, tokens: np.ndarray, lengths: np.ndarray) -> Packed:
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        steps = int(lengths.max()) if len(lengths) else 0
        active = np.cumsum(np.bincount(lengths, minlength=steps + 1)[::-1])[::-1][1:]  # sequences longer than t
        offset = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
        packed, owner = np.empty_like(tokens), np.empty(len(tokens), np.int32)
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(lengths):  # some sequences at a time, as the places are wide
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SWEEP, side="right")))
            size, start = lengths[begin:end], int(ends[begin] - lengths[begin])
            total = int(size.sum())
            step = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
            place = offset[step] + np.repeat(rank[begin:end], size)
            packed[place] = tokens[start : start + total]
            owner[place] = np.repeat(np.arange(begin, end, dtype=np.int32), size)
            begin = end
        return cls(packed, owner, offset)

    def spans(self) -> list[tuple[int, int]]:
        """Runs of steps with about SWEEP tokens each."""
        edges = [0]
        while edges[-1] < len(self.offset) - 1:
            edges.append(max(edges[-1] + 1, int(np.searchsorted(self.offset, self.offset[edges[-1]] + SWEEP, side="right")) - 1))
        return list(zip(edges[:-1], edges[1:], strict=True))

    def forward(self, emit: np.ndarray, t0: int, t1: int, before: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """Turn the emissions of steps t0 to t1 into scaled forward values in place; returns the scales.
        ``before`` has the values of step t0 - 1."""
        base, ones = self.offset[t0], np.ones(emit.shape[1], emit.dtype)
        scale, edges = np.empty(len(emit), emit.dtype), (self.offset[t0 : t1 + 1] - base).tolist()
        for t in range(t0, t1):
            a, b = edges[t - t0], edges[t - t0 + 1]
            now = emit[a:b]
            now *= (before[: b - a] @ moves) if t else first
            total = np.dot(now, ones, out=scale[a:b])
            now /= total[:, None]
            before = now
        return scale


def sweep(packed: Packed, emissions: np.ndarray, first: np.ndarray, moves: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Scales of the forward recursion, span by span; their logarithms add up to the likelihood."""
    before = np.zeros((0, len(first)), emissions.dtype)
    for t0, t1 in packed.spans():
        rows = slice(packed.offset[t0], packed.offset[t1])
        emit = emissions[packed.tokens[rows]]
        scale = packed.forward(emit, t0, t1, before, first, moves)
        before = emit[packed.offset[t1 - 1] - packed.offset[t0] :]
        yield rows, scale


def expected(packed: Packed, emissions: np.ndarray, first: np.ndarray, moves: np.ndarray, at: np.ndarray, profiles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of (profile, state), of transitions and of first states: the E-step of Baum-Welch.

    Where the sequences have more than one span, only the forward values at the spans' starts are kept and
    the others are computed again on the way back, so memory holds one span.
    """
    k = len(first)
    counts, pairs, starts = np.zeros((profiles, k)), np.zeros((k, k)), np.zeros(k)
    spans, before, kept = packed.spans(), np.zeros((0, k), emissions.dtype), []
    one = len(spans) == 1
    for t0, t1 in spans if not one else []:
        kept.append(before)
        emit = emissions[packed.tokens[packed.offset[t0] : packed.offset[t1]]]
        packed.forward(emit, t0, t1, before, first, moves)
        before = emit[packed.offset[t1 - 1] - packed.offset[t0] :].copy()
    later = np.zeros((0, k), emissions.dtype)  # emission * backward / scale of the step behind
    back = np.ascontiguousarray(moves.T)
    for (t0, t1), before in zip(reversed(spans), reversed(kept or [before]), strict=True):
        tokens = packed.tokens[packed.offset[t0] : packed.offset[t1]]
        forward = emissions[tokens]
        scale = packed.forward(forward, t0, t1, before, first, moves)
        after = emissions[tokens]
        after /= scale[:, None]
        edges = (packed.offset[t0 : t1 + 1] - packed.offset[t0]).tolist()
        for t in range(t1 - 1, t0 - 1, -1):
            a, b = edges[t - t0], edges[t - t0 + 1]
            n = len(later)
            if n:
                pairs += forward[a : a + n].T @ later
                beta = later @ back
                forward[a : a + n] *= beta  # the posterior, once the backward values are in
                after[a : a + n] *= beta
            later = after[a:b]
        forward /= (forward @ np.ones(k, forward.dtype))[:, None]  # rounding adds up along a text
        if t0:
            later = later.copy()
        else:
            starts += forward[: edges[1]].sum(axis=0)
        profile = at[tokens]
        for s in range(k):
            counts[:, s] += np.bincount(profile, forward[:, s], profiles)
    return counts, pairs * moves, starts


@dataclass
class Hmm:
    """States' first probabilities and transitions; ``ratios`` has the emission profiles (profile, r)."""

    first: np.ndarray
    moves: np.ndarray
    tokens: int
    distinct: int
    ratios: DataFrame | None = None

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    def emissions(self, ratios: np.ndarray, counts: np.ndarray, at: np.ndarray, kind: type) -> np.ndarray:
        """(entries, states) probabilities, from the profiles' ratios, the entries' counts and profiles."""
        return ((counts[:, None] * ratios[at] + 0.5) / self.whole).astype(kind)


def from_counts(counts: np.ndarray) -> np.ndarray:
    """Rows of expected transitions or first states as probabilities; one is added to each."""
    counts = np.asarray(counts, np.float64) + 1
    return counts / counts.sum(axis=-1, keepdims=True)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, lengths, counts, at) of a recoded block."""
    return tuple(np.frombuffer(row[c], kind) for c, kind in (("tokens", "<i4"), ("lengths", "<i4"), ("counts", "<i8"), ("at", "<i4")))


def first_guess(texts: list[np.ndarray], states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(profiles, their ratios by state, first, moves) learned from a few texts given as profiles: clusters
    of texts, the farthest from each other first, then Baum-Welch with the clusters as first states."""
    profiles, flat = np.unique(np.concatenate(texts), return_inverse=True)
    lengths = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    bags = np.zeros((len(texts), 4096))
    np.add.at(bags, (owner, (profiles[flat] * 2654435761 >> 7) % 4096), 1)
    idf = np.log((1 + len(bags)) / (1 + (bags > 0).sum(axis=0)))
    bags = np.sqrt(bags) * idf
    bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-12)
    centres = bags[:1]
    while len(centres) < min(states, len(bags)):
        centres = np.vstack([centres, bags[(bags @ centres.T).max(axis=1).argmin()]])
    for _ in range(8):
        near = (bags @ centres.T).argmax(axis=1)
        sums = np.vstack([bags[near == s].sum(axis=0) for s in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    total = np.bincount(flat, minlength=len(profiles)).astype(np.float64)
    near = (bags @ centres.T).argmax(axis=1)
    counts = np.zeros((len(profiles), states))
    np.add.at(counts, (flat, near[owner]), 1.0)
    first, moves = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
    packed = Packed.of(flat.astype(np.int32), lengths)
    for turn in range(SEED_ROUNDS + 1):
        share = (counts.sum(axis=0) + 1e-9) / (counts.sum() + 1e-9 * states)
        ratios = (counts / share + CAUTION) / (total[:, None] + CAUTION)
        if turn < SEED_ROUNDS:
            emissions = (total[:, None] * ratios + 0.5) / (total.sum() + 0.5 * (len(total) + 1))
            counts, pairs, starts = expected(packed, emissions, first, moves, np.arange(len(profiles)), len(profiles))
            first, moves = from_counts(starts), from_counts(pairs)
    return profiles, ratios, first, moves


def seed_texts(coded: DataFrame) -> list[np.ndarray]:
    """The profiles of the texts marked as seeds, in order of their marks: SEEDS texts of SEED_BYTES at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("lengths", "tokens", "counts", "at", "_seed")}
                tokens, lengths, _, at = unpack(row)
                profiles = batch.column("profiles")[i].values.to_numpy()
                ends = np.cumsum(lengths)
                found = [(m, profiles[at[tokens[e - n : e]]].tobytes()) for m, n, e in zip(row["_seed"], lengths, ends, strict=True) if m is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["mark", "profiles"])

    marked = coded.filter(F.exists("_seed", lambda m: m.isNotNull())).select("lengths", "tokens", "counts", "at", "profiles", "_seed")
    # one text a mark, however often an id repeats
    found = marked.mapInArrow(run, "mark long, profiles binary").groupBy("mark").agg(F.min("profiles").alias("profiles")).collect()
    return [np.frombuffer(r.profiles, np.int64) for r in sorted(found, key=lambda r: r.mark)]


def of_blocks(coded: DataFrame, model: Hmm) -> DataFrame:
    """(to, place, r): the ratios of each block's profiles; 1 for a profile of which nothing is known."""
    asked = coded.select(F.col("block").alias("to"), F.posexplode("profiles").alias("place", "profile"))
    ones = F.array(*(F.lit(1.0).cast("float") for _ in model.first))
    return asked.join(model.ratios, "profile", "left").select("to", "place", F.coalesce("r", ones).alias("r"))


def placed(right: pa.Table, states: int) -> np.ndarray:
    """The ratios of a block in order of their places."""
    out = np.empty((right.num_rows, states))
    out[right.column("place").to_numpy()] = right.column("r").combine_chunks().flatten().to_numpy().reshape(-1, states)
    return out


def baum_welch(coded: DataFrame, totals: DataFrame, model: Hmm, keep: Keep) -> Hmm:
    """One round over all training texts: expected counts by block, added up by profile, and the next model."""
    states, names = len(model.first), [f"g{s}" for s in range(len(model.first))]
    shared = Hmm(model.first, model.moves, model.tokens, model.distinct)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("lengths", "tokens", "counts", "at", "_learn")}
        tokens, lengths, counts, at = unpack(row)
        learn = np.array(row["_learn"], bool)
        emissions = shared.emissions(placed(right, states), counts, at, np.float32)
        packed = Packed.of(tokens[np.repeat(learn, lengths)], lengths[learn].astype(np.int64))
        found, pairs, starts = expected(packed, emissions, shared.first.astype(np.float32), shared.moves.astype(np.float32), at, right.num_rows)
        name = left.column("profiles")[0].values.to_numpy()
        some = found.any(axis=1)
        name = np.concatenate([name[some], TRANSITIONS + np.arange(states), [FIRST]])
        values = np.vstack([found[some], pairs, starts])
        return pa.Table.from_arrays([pa.array(name), *(pa.array(values[:, s].astype(np.float32)) for s in range(states))], ["profile", *names])

    left = coded.filter(F.exists("_learn", lambda x: x)).select("block", "_learn", "lengths", "tokens", "counts", "at", "profiles")
    schema = ", ".join(["profile long", *(f"{c} float" for c in names)])
    found = left.groupBy("block").cogroup(of_blocks(left, model).groupBy("to")).applyInArrow(run, schema)
    found = keep(found.groupBy("profile").agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in names)))
    special = {r.profile: [r[c] for c in names] for r in found.filter(F.col("profile") <= FIRST).collect()}  # states + 1 rows
    of_states = found.filter(F.col("profile") > FIRST).agg(*(F.coalesce(F.sum(c), F.lit(0.0)) for c in names)).first()
    share = (np.array(of_states, float) + 1e-9) / (sum(of_states) + 1e-9 * states)
    joined = found.join(totals, "profile")
    r = F.array(*(F.col(c) / F.lit(float(s)) / F.col("total") for c, s in zip(names, share, strict=True)))
    ratios = keep(joined.select("profile", r.cast("array<float>").alias("r")))
    zero = [0.0] * states
    pairs = np.array([special.get(TRANSITIONS + s, zero) for s in range(states)])
    return Hmm(from_counts(special.get(FIRST, zero)), from_counts(pairs), model.tokens, model.distinct, ratios)


def scores(coded: DataFrame, model: Hmm, carried: list[str]) -> DataFrame:
    """One row a document: the carried columns, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    states = len(model.first)
    shared = Hmm(model.first, model.moves, model.tokens, model.distinct)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in ("lengths", "tokens", "counts", "at")}
        tokens, lengths, counts, at = unpack(row)
        emissions = shared.emissions(placed(right, states), counts, at, np.float64)
        packed = Packed.of(tokens, lengths.astype(np.int64))
        base = np.log10((counts + 0.5) / shared.whole)
        sums = np.zeros((3, len(lengths)))
        for rows, scale in sweep(packed, emissions, shared.first, shared.moves):
            own, who = packed.tokens[rows], packed.owner[rows]
            for i, value in enumerate((base[own], np.log10(scale), counts[own] > 0)):
                sums[i] += np.bincount(who, value, len(lengths))
        listed = [left.column(c).combine_chunks().flatten() for c in carried]
        learn = left.column("_learn").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        n = len(lengths)
        made = [pa.array(~learn.astype(bool)), pa.array(lengths.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(np.full(n, shared.tokens, np.int64)),
                pa.array(sums[0]), pa.array(sums[1])]
        return pa.Table.from_arrays([*listed, *made], [*carried, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    left = coded.select("block", *(f"`{c}`" for c in carried), "_learn", "lengths", "tokens", "counts", "at", "profiles")
    kinds = [f"`{c}` {coded.schema[c].dataType.elementType.simpleString()}" for c in carried]
    schema = ", ".join([*kinds, "held_out boolean", "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"])
    return left.groupBy("block").cogroup(of_blocks(left, model).groupBy("to")).applyInArrow(run, schema)


def language_model(
    docs: DataFrame, learn: Column, carried: list[str] | None = None, id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, own: int | None = None,
    block_bytes: int = BLOCK_BYTES, told: list | None = None,
) -> DataFrame:
    """Score all of ``docs`` by a model of those for which ``learn`` holds; ``carried`` columns (id if not given) come along.

    Words are runs of bytes other than white space, A-Z in lower case, and an end behind each text is a
    token too. A null text is empty; a null in ``learn`` counts as true; rows that repeat count as often as
    they stand there. Without training texts every token has probability 1; an empty table gives an empty
    one. Other columns are not read. Models of the rounds are appended to ``told``. One table, the result,
    stays in the shared folder. ``own`` sets the occurrences from which a word has its own profile.
    """
    carried = [id] if carried is None else carried
    spark = docs.sparkSession
    learn = F.coalesce(learn, F.lit(True))
    with scratch(spark) as keep:
        key = F.xxhash64(F.col(f"`{id}`").cast("string"))
        # the seeds are a top-k of ids by hash: their bound is a scalar
        short = docs.filter(learn & (F.octet_length(text) <= SEED_BYTES)).select(key.alias("k")).orderBy("k").limit(SEEDS).agg(F.max("k")).first()[0]
        seed = F.when(learn & (F.octet_length(text) <= SEED_BYTES) & (key <= F.lit(short).cast("long")), key)
        names = {c: f"_c{i}" for i, c in enumerate(carried)}
        asked = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), learn.alias("_learn"), seed.alias("_seed"), F.col(f"`{text}`").alias("_text"))
        blocks = materialise(encoded(asked, list(names.values()), block_bytes))
        n = blocks.agg(F.sum(F.aggregate("trained", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
        words = materialise(lexicon(blocks, max(LEAST, math.ceil(OWN * n)) if own is None else own))
        v = words.agg(F.count_if(F.col("first") & (F.col("c") > 0))).first()[0]
        totals = keep(words.filter("first AND c > 0").groupBy("profile").agg(F.sum("c").cast("double").alias("total")))
        # each round groups by block: buckets spare it the shuffle of all tokens
        coded = bucketed(recoded(blocks, words, list(names.values())), "block")
        release(words)
        release(blocks)
        model = Hmm(np.full(states, 1 / states), np.full((states, states), 1 / states), n, v)
        none = spark.createDataFrame([], "profile long, r array<float>")
        model.ratios = none
        seeds = seed_texts(coded)
        if seeds:
            profiles, ratios, model.first, model.moves = first_guess(seeds, states)
            frame = pa.table({"profile": profiles, "r": pa.array(list(ratios.astype(np.float32)), pa.list_(pa.float32()))})
            model.ratios = keep(spark.createDataFrame(frame))
            for _ in range(rounds):
                model = baum_welch(coded, totals, model, keep)
                if told is not None:
                    told.append(model)
        out = scores(coded, model, list(names.values()))
        out = materialise(out.withColumnsRenamed({n: c for c, n in names.items()}))
        release(coded)
        return out
