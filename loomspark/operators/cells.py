"""A stored index for nearest vectors that proves its answers.

Unit vectors are dealt to the nearest of some centres, and each cell keeps the least and the largest distance
of its vectors to its centre. For a query at distance d from a centre the triangle inequality gives a lower
bound on its distance to any vector of the cell. The cells nearest to the query are read first; of the others
only those whose bound does not rule out a place among the k best. So the rows are those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Centres are fitted on so many vectors at most, those with the smallest hashes, and there are at most so many.
SAMPLE, CELLS = 20_000, 1024
#: Cells of a query read first; vectors and queries of one product at most.
FIRST, TILE = 4, 4096
#: Room for rounding where a bound is compared with a similarity of six digits.
MARGIN = 2e-6


@dataclass
class CellIndex:
    centres: np.ndarray  # (cells, dim), bounded by CELLS
    nearest: np.ndarray  # of each cell's vectors, the least distance to its centre
    farthest: np.ndarray
    rows: np.ndarray
    table: DataFrame  # id, vector, gap, cell


def unit(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """(id, vector) of rows with ``dim`` finite components that are not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = vectors.filter(F.col(id).isNotNull() & (F.size(vector) == dim) & F.coalesce(good, F.lit(False)))
    return rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def fitted(rows: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres by k-means over unit vectors, begun at evenly spaced rows; empty cells are left out."""
    centres = rows[np.linspace(0, len(rows) - 1, min(cells, len(rows))).astype(int)]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums[length[:, 0] > 1e-9] / length[length[:, 0] > 1e-9]
    return centres


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * rows @ centres.T, 0))


def build(vectors: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> CellIndex | None:
    """Write the index of ``vectors`` below ``path``; None if none is usable. All rows are indexed, a sample fits the centres."""
    spark = vectors.sparkSession
    sizes = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    own = usable(vectors, id, vector, sizes[0].d)
    count = own.count()
    sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if not count:
        return None
    centres = fitted(unit(sample["vector"]), cells or min(CELLS, max(1, round(count**0.5))))

    def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = distances(unit(part["vector"]), centres)
                near = d.argmin(axis=1)
                yield part.assign(gap=d[np.arange(len(d)), near], cell=near.astype(np.int32))

    dealt = own.mapInPandas(deal, "id long, vector array<double>, gap double, cell int")
    # a cell of many vectors is several files
    dealt.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    return opened(spark, path, centres)


def opened(spark: SparkSession, path: str, centres: np.ndarray) -> CellIndex:
    table = spark.read.schema("id long, vector array<double>, gap double, cell int").parquet(path)
    near, far, rows = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in table.groupBy("cell").agg(F.min("gap"), F.max("gap"), F.count("*")).collect():  # one row a cell
        near[r[0]], far[r[0]], rows[r[0]] = r[1], r[2], r[3]
    return CellIndex(centres, near, far, rows, table)


def _products(index: CellIndex, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, sim): the k best of each asked (query_id, query, cell), cell by cell."""
    parts = np.maximum(1, -(-index.rows // TILE)).astype(np.int32)
    of_cell = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("cell") + 1)
    tile = F.pmod(F.xxhash64("id"), of_cell).cast("int")
    rows = index.table.select("cell", "id", "vector", tile.alias("tile"))
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # at most CELLS
    rows = rows.filter(F.col("cell").isin(wanted))
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0), of_cell - 1)))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            vectors, ids = unit(right["vector"]), right["id"].to_numpy()
            for start in range(0, len(left), 512):
                some = left.iloc[start : start + 512]
                sims = np.round(unit(some["query"]) @ vectors.T, 6)
                for query, row in zip(some["query_id"].to_numpy(), sims, strict=True):
                    few = row >= np.partition(row, -k)[-k] if len(row) > k else np.ones(len(row), bool)
                    at = np.flatnonzero(few)
                    at = at[np.lexsort((ids[at], -row[at]))[:k]]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[at], "sim": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "sim": np.zeros(0)})

    return asked.groupBy("cell", "tile").cogroup(rows.groupBy("cell", "tile")).applyInPandas(product, "query_id long, id long, sim double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: CellIndex, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", first: int = FIRST, told: dict | None = None) -> DataFrame:
    """(query_id, id, sim, rank): the k vectors with the highest cosine (6 digits) to each query, ties by id.

    Queries that are null, zero, not finite or of another length give no row. ``told`` gets the numbers of
    (query, cell) pairs there are and of those that were read.
    """
    own = usable(queries, id, vector, index.centres.shape[1]).select(F.col("id").alias("query_id"), F.col("vector").alias("query")).cache()
    centres, near, far, rows = index.centres, index.nearest, index.farthest, index.rows
    shape = "query_id long, query array<double>, cell int"

    def begin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = np.where(rows > 0, distances(unit(part["query"]), centres), np.inf)
                best = np.argsort(d, axis=1, kind="stable")[:, :first].astype(np.int32)
                yield part.assign(cell=list(best)).explode("cell").astype({"cell": np.int32})

    head = own.mapInPandas(begin, shape)
    found = _best(_products(index, head, k), k).drop("rank").cache()
    least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))

    def rest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                d = distances(unit(part["query"]), centres)
                gap = np.maximum(np.maximum(d - far, near - d), 0)  # no vector of the cell is nearer
                done = np.argsort(np.where(rows > 0, d, np.inf), axis=1, kind="stable")[:, :first]
                still = (1 - gap**2 / 2 + MARGIN >= part["least"].fillna(-2).to_numpy()[:, None]) & (rows > 0)
                np.put_along_axis(still, done, False, axis=1)
                yield part[["query_id", "query"]].assign(cell=[np.flatnonzero(x).astype(np.int32) for x in still]).explode("cell").dropna().astype({"cell": np.int32})

    more = own.join(least, "query_id", "left").mapInPandas(rest, shape).cache()
    if told is not None:
        asked = own.count()
        told |= {"cells": asked * int((rows > 0).sum()), "read": min(first, int((rows > 0).sum())) * asked + more.count()}
    return _best(found.unionByName(_products(index, more, k)), k)
