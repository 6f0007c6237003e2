"""Operator 6: a byte-level convolutional network for text quality, in numpy.

A text is cut into overlapping chunks that cover all of its bytes. Learned filters over a few bytes run
along every chunk; a chunk keeps the largest response of each filter. Over the whole document these are
combined by mean and by maximum, and a logistic layer turns them into one probability. Training uses a
bounded sample of labelled rows on the driver; scoring runs over all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.shared import slices

CHUNK, WIDTH, FILTERS = 256, 5, 16
#: Labelled rows at most that training sees, by label, with their whole texts. More good than bad rows, as
#: in the corpus: doubt then counts for the text.
SAMPLE = {0: 1000, 1: 2500}
#: Chunks convolved at a time: 1 MB of responses.
BLOCK = 64


def chunks(data: bytes) -> np.ndarray:
    """(count, CHUNK) bytes; neighbours overlap by WIDTH - 1, the last is filled with zeros."""
    stride = CHUNK - WIDTH + 1
    count = max(1, -(-(len(data) - WIDTH + 1) // stride))
    whole = np.zeros((count - 1) * stride + CHUNK, np.uint8)
    whole[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(whole, CHUNK)[::stride]


@dataclass
class ByteCnn:
    filters: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2 * FILTERS,): of the means, then of the maxima
    intercept: float

    def pooled(self, rows: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(rows, FILTERS) largest responses, and their positions if asked for."""
        span = CHUNK - WIDTH + 1
        tops, places = [], []
        for start in range(0, len(rows), BLOCK):
            block = rows[start : start + BLOCK]
            out = np.take(self.filters[0], block[:, :span], axis=0)
            for k in range(1, WIDTH):
                out += np.take(self.filters[k], block[:, k : k + span], axis=0)
            if where:
                at = out.argmax(axis=1)
                places.append(at)
                tops.append(np.take_along_axis(out, at[:, None, :], axis=1)[:, 0])
            else:
                tops.append(out.max(axis=1))
        return np.maximum(np.concatenate(tops) + self.bias, 0), np.concatenate(places) if where else None

    def score(self, texts: list[str | None]) -> np.ndarray:
        parts = [chunks((t or "").encode("utf-8")) for t in texts]
        if not parts:
            return np.zeros(0)
        sizes = np.array([len(p) for p in parts])
        pooled, _ = self.pooled(np.concatenate(parts))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(pooled, first, axis=0) / sizes[:, None]
        z = np.hstack([mean, np.maximum.reduceat(pooled, first, axis=0)]) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = 14, batch: int = 24, rate: float = 0.01, seed: int = 5) -> ByteCnn:
    """Fit by Adam on the logistic loss. Gradients reach a filter through the bytes of its maximum only."""
    rng = np.random.default_rng(seed)
    net = ByteCnn(
        rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0,
    )
    data, y = [chunks(t.encode("utf-8")) for t in texts], np.array(labels, np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart: a constant
        net.weights[:], net.intercept = 0, -4.0 if labels and not labels[0] else 4.0
        return net
    values = [net.filters, net.bias, net.weights, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for start in range(0, len(order), batch):
            picked = order[start : start + batch]
            parts = [data[i] for i in picked]
            sizes = np.array([len(p) for p in parts])
            rows = np.concatenate(parts)
            pooled, at = net.pooled(rows, where=True)
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(parts)), sizes)
            mean = np.add.reduceat(pooled, first, axis=0) / sizes[:, None]
            most = np.maximum.reduceat(pooled, first, axis=0)
            features = np.hstack([mean, most])
            z = features @ values[2] + values[3][0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[picked]) / len(picked)
            grad_rows = (error[:, None] * values[2][:FILTERS])[owner] / sizes[owner][:, None]
            hit = (pooled == most[owner]).astype(np.float32)
            hit /= np.add.reduceat(hit, first, axis=0)[owner]  # chunks that tie for a maximum share its gradient
            grad_rows = (grad_rows + hit * (error[:, None] * values[2][FILTERS:])[owner]) * (pooled > 0)
            grad = np.empty_like(values[0])
            column = np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                byte = rows[np.arange(len(rows))[:, None], at + k].astype(np.int64)
                grad[k] = np.bincount((byte * FILTERS + column).ravel(), grad_rows.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = [grad, grad_rows.sum(axis=0), features.T @ error + 1e-4 * values[2], np.array([error.sum()], np.float32)]
            step += 1
            for v, g, (m, s) in zip(values, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            net.intercept = float(values[3][0])
    return net


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE, **options) -> ByteCnn:
    """Train on at most ``sample`` labelled rows of each class, outside the held-out fold.

    The rows with the smallest hashes are taken; their number is bounded, so what reaches the driver
    does not grow with the input. Null texts are left out; of an id that documents or labels repeat, the
    rows first in order are taken. Without labels of both classes the network gives a constant: the only
    label's, or 1.
    """
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("_y"))
    picked = None
    for y in (0, 1):
        # top-k by hash, a bounded number of rows and therefore safe to broadcast
        some = known.filter(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[y])
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "_y").filter("text IS NOT NULL")
    # a top-k: more rows than labels there are only where ids repeat
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text", "_y").limit(sum(sample.values())).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text, r._y))
    return train([r.text for r in rows], [r._y for r in rows], **options)


def score(docs: DataFrame, net: ByteCnn, least: float = 0.7) -> DataFrame:
    """Add score (double) and predicted (int) to ``docs``; texts are read whole, null as empty.

    Rows are scored one by one, so repeated rows get equal scores. Columns of the names added are
    replaced; other columns stay. An empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 80 kB, fixed by the shape of the network
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                p = net.score(part.column("text").to_pylist())
                made = [pa.array(p, pa.float64()), pa.array((p >= least).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["score double", "predicted int"])
    return docs.mapInArrow(run, schema)
