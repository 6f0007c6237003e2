"""Operator 7: near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated by random orthonormal matrices and kept as its signs, with one stored factor a
rotation: the inner product of the rotated vector with its own normalised sign vector. The product of
one vector's signs with another rotated vector, divided by that factor, is an unbiased estimate of
their inner product with a known error. Pairs whose upper bound stays below the threshold are dropped
on their codes alone; every other pair is recomputed in double precision, so no pair below the threshold
is ever linked.

Candidates are vectors of one label that agree on a whole band of code bits. Only ids and codes meet in the
bands; a vector is fetched where its code is near that of another one. A pair is judged in the
first band that it shares, nowhere else. A band holding many vectors is cut into tiles and each pair of
tiles is a task of its own, so a large group of near copies is spread, and no pair leaves a tile: what
leaves is a count for each vector and a spanning forest of links. Equal vectors are one row with a
multiplicity throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.shared import connected_components, materialise

BITS = 64  # of a rotation
#: Rows of a tile: two tiles of 64 doubles and their products stay below 50 MB.
TILE = 1024
#: Bands of so many rows at most are compared pair by pair, larger ones as matrices.
SMALL = 32
#: Share of pairs exactly at the threshold that may share no band; closer pairs are missed far less.
MISS = 0.02
#: Standard deviations allowed below the threshold before a pair is dropped on its codes.
SIGMAS = 5.0


def band_plan(rows: int, threshold: float, per_band: int = 64) -> tuple[int, int]:
    """(bits of a band, bands): bits grow with the logarithm of the rows, bands keep the miss rate."""
    bits = min(32, max(8, math.ceil(math.log2(max(rows, 1) / per_band)) if rows > per_band else 8))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree))


def rotations(dim: int, count: int, seed: int) -> np.ndarray:
    """(dim, count * dim): random orthonormal matrices side by side, the same for every task."""
    rng = np.random.default_rng(seed)
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


def encode(rotated: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits (rows, rotations * dim) and the stored factors (rows, rotations)."""
    each = np.abs(rotated).reshape(len(rotated), -1, dim)
    return rotated > 0, each.sum(axis=2) / math.sqrt(dim)


def estimate(signs: np.ndarray, factors: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products (rows of signs, rows of rotated), and the standard error for each row of signs.

    For one rotation, <signs / sqrt(dim), rotated> / factor is unbiased with variance
    (1 - factor^2) / factor^2 / (dim - 1) at most; the rotations are averaged.
    """
    turns = factors.shape[1]
    dim = signs.shape[1] // turns
    scaled = np.where(signs, 1.0, -1.0).reshape(len(signs), turns, dim) / (factors * math.sqrt(dim) * turns)[:, :, None]
    variance = np.clip(1 - factors**2, 0, 1) / factors**2 / max(dim - 1, 1)
    return scaled.reshape(len(signs), -1) @ rotated.T, np.sqrt(variance.sum(axis=1)) / turns


def _forest(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges (id, root id) that connect what the local links a-b connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(int(ids[x]), int(ids[root(x)])) for x in parent if root(x) != x]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", vector: str = "embedding", label: str = "label", seed: int = 7
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, and other columns that came in.

    Links join vectors of one non-null label at cosine >= threshold. A vector that is null, empty,
    zero or holds a null or non-finite component links with nothing and is its own component; vectors of
    different lengths never link. Vectors are scaled by their largest component first, so no square over- or
    underflows. Ids are whole numbers (others are an error) and expected to be unique: rows that repeat an id with the same vector count as copies, rows
    that repeat it with another vector are one node of the graph and get the larger count. An empty table
    gives an empty result. The number of links counts copies.
    """
    made = ("n_links", "component_id", "kept")
    vectors = vectors.drop(*made)
    if vectors.schema[id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id} must hold whole numbers")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    usable = F.col(label).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.filter(usable).select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    alike = rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    alike = materialise(alike)
    size = alike.groupBy(F.size("v").alias("dim")).count().collect()  # one row a vector length
    members = rows.join(alike.select("label", "v", "rep", "n"), ["label", "v"]).select("id", "rep", "n")

    found = None
    for dim, count in ((r["dim"], r["count"]) for r in size):
        part = _links(alike.filter(F.size("v") == dim), dim, count, threshold, seed)
        found = part if found is None else found.unionByName(part)
    if found is None:
        blank = vectors.select("*", F.lit(0).cast("long").alias("n_links"), F.col(id).alias("component_id"))
        return blank.withColumn("kept", F.lit(True))
    found = materialise(found)
    edges = found.filter("other IS NOT NULL").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    groups = connected_components(edges)
    links = found.filter("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    members = members.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    members = members.select(
        F.col("id").alias("_id"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    ).groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.join(members, F.col(id) == F.col("_id"), "left").drop("_id")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0).cast("long")), "component_id": F.coalesce("component_id", F.col(id))})
    return out.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))


def _links(alike: DataFrame, dim: int, count: int, threshold: float, seed: int) -> DataFrame:
    """(rep, other, links): counts of links for each rep (other null), and forest edges rep - other."""
    bits, bands = band_plan(count, threshold)
    turns = math.ceil(bits * bands / dim)

    def band_keys(signs: np.ndarray) -> np.ndarray:
        return signs[:, : bits * bands].reshape(len(signs), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))

    def codes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = rotations(dim, turns, seed)
        for part in parts:
            vectors = np.stack(part["v"].to_numpy())
            signs, factors = encode(_unit(vectors) @ turned, dim)
            columns = {k: [x.tobytes() for x in m] for k, m in (("code", np.packbits(signs, axis=1)), ("factors", factors), ("raw", vectors))}
            yield pd.DataFrame({"label": part["label"], "rep": part["rep"], "n": part["n"], "keys": list(band_keys(signs)), **columns})

    label_type = alike.schema["label"].dataType.simpleString()
    kind = np.float32 if alike.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    alike = alike.withColumn("v", F.col("v").cast("array<float>" if kind is np.float32 else "array<double>"))
    coded = alike.mapInPandas(
        codes, f"label {label_type}, rep bigint, n bigint, keys array<bigint>, code binary, factors binary, raw binary"
    )
    coded = materialise(coded)
    spread = coded.select("label", "rep", "code", F.posexplode("keys").alias("band", "key"))
    sizes = spread.groupBy("label", "band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    placed = spread.join(sizes, ["label", "band", "key"])
    # a vector of tile t meets every tile of its band: pair (low, high) once
    placed = placed.withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")})
    # small bands travel together: one group of rows for a task, many bands inside
    bin_ = F.when(F.col("tiles") > 1, F.xxhash64("label", "band", "key", "low", "high")).otherwise(
        F.pmod(F.xxhash64("label", "band", "key"), F.lit(max(64, count * bands // (8 * TILE))))
    )
    where = ["bin", "label", "band", "key", "low", "high", "tile"]
    placed = placed.withColumn("bin", bin_).select(*where, "rep", "code")
    width = turns * dim
    share = math.acos(threshold) / math.pi  # of bits in which vectors at the threshold differ, on average
    apart = width * (share + SIGMAS * math.sqrt(share * (1 - share) / width))

    def sift(group: pd.DataFrame) -> pd.DataFrame:
        """The rows of each tile that are near some other by their codes: only these ask for their vectors."""
        band = group.groupby(["label", "band", "key", "low", "high"], sort=False).ngroup().to_numpy()
        order = np.argsort(band, kind="stable")
        group, band = group.iloc[order], band[order]
        codes = np.frombuffer(b"".join(group["code"]), np.uint8).reshape(len(group), -1)
        codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
        parted, side = (group["low"] != group["high"]).to_numpy(), (group["tile"] == group["low"]).to_numpy()
        near, held = np.zeros(len(group), bool), np.bincount(band)
        # small bands at once: rows that stand so many places apart in one band
        few = np.flatnonzero(held[band] <= SMALL)
        for k in range(1, SMALL):
            at = np.flatnonzero(band[few[k:]] == band[few[:-k]]) if len(few) > k else few[:0]
            if not len(at):
                break
            i, j = few[at], few[at + k]
            hit = (np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1) <= apart) & (~parted[i] | (side[i] != side[j]))
            near[i[hit]] = near[j[hit]] = True
        ends = np.cumsum(held)
        for g in np.flatnonzero(held > SMALL):
            rows = np.arange(ends[g] - held[g], ends[g])
            left, right = (rows, rows) if not parted[rows[0]] else (rows[side[rows]], rows[~side[rows]])
            signs = [np.where(np.unpackbits(codes[x].view(np.uint8), axis=1)[:, :width], np.float32(1), np.float32(-1)) for x in (left, right)]
            met = signs[0] @ signs[1].T >= width - 2 * apart
            if not parted[rows[0]]:
                np.fill_diagonal(met, False)
            near[left] |= met.any(axis=1)
            near[right] |= met.any(axis=0)
        return group[near][[*where, "rep"]]

    sifted = placed.groupBy("bin").applyInPandas(sift, f"bin bigint, label {label_type}, band int, key bigint, low int, high int, tile int, rep bigint")
    placed = sifted.join(coded.select("rep", "n", "code", "factors", "raw"), "rep").select(*where, "rep", "n", "code", "factors", "raw")

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        turned = rotations(dim, turns, seed)
        out_rep, out_other, out_links = [], [], []
        for (band, low, high), one in _runs(group):
            first = one["tile"].to_numpy() == low
            left, right = (one, one) if low == high else (one[first], one[~first])
            if len(left) == 0 or len(right) == 0:
                continue
            signs_l, signs_r = _bits(left["code"], turns * dim), _bits(right["code"], turns * dim)
            unit_l, unit_r = _unit(_matrix(left["raw"], kind)), _unit(_matrix(right["raw"], kind))
            about, error = estimate(signs_l, _matrix(left["factors"], np.float64), unit_r @ turned)
            maybe = about + SIGMAS * error[:, None] >= threshold
            if low == high:
                maybe &= np.triu(np.ones(maybe.shape, bool), 1)
            a, b = np.nonzero(maybe)
            if band:
                keys_l, keys_r = band_keys(signs_l)[:, :band], band_keys(signs_r)[:, :band]
                fresh = np.ones(len(a), bool)
                for k in range(band):
                    fresh &= keys_l[a, k] != keys_r[b, k]
                a, b = a[fresh], b[fresh]
            blocks = range(0, len(a), 65536)
            exact = [np.einsum("ij,ij->i", unit_l[a[s : s + 65536]], unit_r[b[s : s + 65536]]) for s in blocks]
            near = np.concatenate(exact or [np.zeros(0)]) >= threshold
            a, b = a[near], b[near]
            if not len(a):
                continue
            rep_l, rep_r = left["rep"].to_numpy(), right["rep"].to_numpy()
            n_l, n_r = left["n"].to_numpy(), right["n"].to_numpy()
            for reps, links in ((rep_l, np.bincount(a, n_r[b], len(rep_l))), (rep_r, np.bincount(b, n_l[a], len(rep_r)))):
                some = links > 0
                out_rep += reps[some].tolist()
                out_other += [None] * int(some.sum())
                out_links += links[some].astype(np.int64).tolist()
            both = np.concatenate([rep_l, rep_r])
            for x, y in _forest(a, b + len(rep_l), both) if low != high else _forest(a, b, rep_l):
                out_rep.append(x)
                out_other.append(y)
                out_links.append(0)
        return pd.DataFrame({"rep": np.array(out_rep, np.int64), "other": pd.array(out_other, "Int64"), "links": np.array(out_links, np.int64)})

    return placed.groupBy("bin").applyInPandas(judge, "rep bigint, other bigint, links bigint")


def _runs(group: pd.DataFrame) -> Iterator[tuple[tuple[int, int, int], pd.DataFrame]]:
    for (_, band, _, low, high), one in group.groupby(["label", "band", "key", "low", "high"], sort=False):
        yield (band, low, high), one


def _bits(codes: pd.Series, width: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, axis=1)[:, :width].astype(bool)


def _matrix(rows: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
