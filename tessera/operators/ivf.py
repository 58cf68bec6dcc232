"""Approximate search: an inverted file as data.

Chunks get the id of their nearest centroid; a query probes the nearest few
centroids' lists and ranks them exactly.  The list id is a column, so a table
partitioned by it is pruned at the scan.

A search given the lists' radii is exact: it goes on to every list that can hold
a nearer chunk.  A join probes as many lists as a sample of its own probes needs
for ``RECALL``, measured against the exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.neighbours import grid_side, merge_chunks
from tessera.operators.neighbours import knn_join as exact_join

#: Rows that the centroids are fitted on, at most.
TRAIN_ROWS = 20_000
FLAT_ROWS = 256
NPROBES = 4
#: Share of the sampled probes' true neighbours that a join must reach; 0.9 is promised.
RECALL = 0.95
#: Probes that the number of lists is chosen on, at most.
CALIBRATION_ROWS = 400


def partitions(n: int) -> int:
    """Lists for n rows: at least 16, then 0.75 times the root."""
    return max(16, round(0.75 * n**0.5))


def needs_index(n: int, force: bool = False) -> bool:
    """Below this many rows a flat scan serves; force skips the fixed floor."""
    return n >= (partitions(n) if force else max(partitions(n), FLAT_ROWS))


def train(chunks: DataFrame, lists: int, rows: int = TRAIN_ROWS, rounds: int = 10) -> np.ndarray:
    """Unit centroids by spherical k-means on a bounded sample chosen by hash."""
    taken = chunks.select("embedding", F.xxhash64("doc_id", "chunk_index").alias("h"), "doc_id", "chunk_index").orderBy("h", "doc_id", "chunk_index").limit(rows)
    m = V.unit_rows(np.array([np.asarray(r.embedding, np.float64) for r in taken.collect()]))
    lists = min(lists, len(m))
    rng = np.random.default_rng(5)
    centroids = m[rng.choice(len(m), lists, replace=False)]
    for _ in range(rounds):
        near = (m @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, m)
        full = np.bincount(near, minlength=lists) > 0
        centroids[full] = V.unit_rows(sums[full])
    return centroids


def assign(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """chunks with ``list_id``; new rows can be assigned later with the same centroids."""

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        m = V.unit_rows(np.array([np.asarray(x, np.float64) for x in v]).reshape(len(v), -1))
        return pd.Series((m @ centroids.T).argmax(axis=1).astype("int32") if len(v) else np.zeros(0, "int32"))

    return chunks.withColumn("list_id", nearest("embedding"))


def radii(indexed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Greatest chord from each centroid to a chunk of its list; -inf for an empty list."""

    @F.pandas_udf("double")
    def chord(v: pd.Series, at: pd.Series) -> pd.Series:
        m = V.unit_rows(np.array([np.asarray(x, np.float64) for x in v]).reshape(len(v), -1))
        return pd.Series(np.sqrt(((m - centroids[at.to_numpy()]) ** 2).sum(axis=1)) if len(v) else np.zeros(0))

    out = np.full(len(centroids), -np.inf)
    for row in indexed.groupBy("list_id").agg(F.max(chord("embedding", "list_id")).alias("r")).collect():
        out[row.list_id] = row.r
    return out


def search(indexed: DataFrame, centroids: np.ndarray, probe: list[float], k: int, nprobes: int = NPROBES, radii: np.ndarray | None = None) -> DataFrame:
    """k nearest chunks of the probed lists; with radii, of all lists."""
    q = V.unit_rows(np.array([probe], np.float64))[0]
    near = np.argsort(-(centroids @ q), kind="stable")[:nprobes].tolist()
    top = lambda lists: V.with_distance(indexed.where(F.col("list_id").isin(lists)), probe).orderBy("distance", "doc_id", "chunk_index").limit(k)
    if radii is None:
        return top(near)
    first = [r.distance for r in top(near).select("distance").collect()]
    # no chunk of a list is nearer than this; distances are rounded, so a little less
    least = np.maximum(np.sqrt(((centroids - q) ** 2).sum(axis=1)) - radii, 0) ** 2 / 4 - 1e-8
    return top(np.flatnonzero(least <= (max(first) if len(first) == k else np.inf)).tolist())


def enough_probes(probes: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, threshold: float | None = None) -> int:
    """Fewest lists that hold a share ``RECALL`` of the true neighbours of a sample of the probes."""
    h = F.xxhash64("doc_id", "chunk_index")
    taken = probes.select("doc_id", "chunk_index", "embedding").orderBy(h, "doc_id", "chunk_index").limit(CALIBRATION_ROWS)
    own = taken.collect()
    # the sample is fixed by its rows, so every use of it is the same
    taken = probes.sparkSession.createDataFrame(own, taken.schema)
    lists = indexed.select(F.col("doc_id").alias("nbr_id"), F.col("chunk_index").alias("nbr_chunk"), "list_id")
    found = exact_join(taken, indexed, k, threshold, shape=(1, grid_side(indexed) ** 2)).join(lists, ["nbr_id", "nbr_chunk"]).select("src_id", "src_chunk", "list_id").collect()
    if not found:
        return len(centroids)
    m = V.unit_rows(np.array([np.asarray(r.embedding, np.float64) for r in own]))
    place = np.argsort(np.argsort(-(m @ centroids.T), axis=1, kind="stable"), axis=1)
    row = {(r.doc_id, r.chunk_index): i for i, r in enumerate(own)}
    need = np.sort([place[row[r.src_id, r.src_chunk], r.list_id] + 1 for r in found])
    return int(need[int(np.ceil(RECALL * len(need))) - 1])


def knn_join(probes: DataFrame, indexed: DataFrame, centroids: np.ndarray, k: int, threshold: float | None = None, nprobes: int | None = None) -> DataFrame:
    """Approximate kNN join: on the grid of the exact one, a cell's candidates list by list.

    A probe is multiplied with its nearest ``nprobes`` lists only.  Its vector is
    shuffled once for each group of candidates, not for each list.  Without ``nprobes`` their number is that of ``enough_probes``.
    """
    if nprobes is None:
        nprobes = enough_probes(probes, indexed, centroids, k, threshold)

    def probed(m: np.ndarray) -> np.ndarray:
        out = np.ones((len(m), len(centroids)), bool)
        if nprobes < len(centroids):
            out[:] = False
            np.put_along_axis(out, np.argpartition(-(m @ centroids.T), nprobes - 1, axis=1)[:, :nprobes], True, axis=1)
        return out

    return merge_chunks(exact_join(probes, indexed, k, threshold, probed=probed), k)
