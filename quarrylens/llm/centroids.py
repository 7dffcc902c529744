"""Centroid clustering, whose vectors find their nearest centroid by the threshold algorithm of Fagin, Lotem and Naor.

For every dimension the centroids are listed in the order of their values. From a vector's own value each list is
walked outward, the nearer side first; a centroid that some list shows for the first time gets its exact distance.
The next values of all lists are the frontier: no centroid that is still unseen is nearer than the sum of their squared
differences. A vector stops when this sum strictly exceeds the best exact distance, so equal distances
are all seen and go to the smaller number.

All numbers are integers, so sums and distances are exact and independent of the order of rows. Vectors stay in Spark: a
round is one pass that adds up each cluster within a task, and one small aggregation of clusters times dimensions, the
only thing that comes to the driver.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part. Components
are kept within ``limit(dim)`` units of zero (half a million in 64 dimensions at the given scale), as distances beyond have
no long. Rows without id are assigned but start no cluster (if no row has one, the smallest vector starts the only one);
repeated rows count each; of equal ids the smaller vector starts a cluster. With fewer rows than clusters there are fewer clusters. Sums beyond a long are null. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import MAX_LONG, materialize

SCALE = 256
CHUNK = 1024


def limit(dim: int) -> int:
    """Bound of the components with which squared distances in ``dim`` dimensions are longs: 2 ** 27 for 64."""
    return 1 << (60 - (dim - 1).bit_length()) // 2


def integers(vectors: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id long, x array<long>): the vectors that take part, rounded down to multiples of 1 / scale."""
    v = F.col(vector_col).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    most = float(limit(dim))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))).cast("long"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x"))


class SortedLists:
    """The centroids' values in each dimension in order, with whose they are; one entry beyond either end."""

    def __init__(self, centroids: np.ndarray):
        k, dim = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable").T
        self.centroids, self.n, self.dims = centroids, k, np.arange(dim)
        self.beyond = 2 * limit(dim) + 1  # farther than any two values
        self.value = np.take_along_axis(centroids.T, order, axis=1)
        self.padded = np.pad(self.value, ((0, 0), (1, 1)))
        self.number = np.pad(order, ((0, 0), (1, 1)))

    def _gaps(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left = np.where(low > 0, x - self.padded[self.dims, low], self.beyond)
        return left, np.where(high <= self.n, self.padded[self.dims, high] - x, self.beyond)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each row's nearest centroid, and how many exact distances that took."""
        rows, k = len(x), self.n
        number, best, exact = np.zeros(rows, np.int64), np.full(rows, MAX_LONG), 0
        low = np.stack([np.searchsorted(v, c) for v, c in zip(self.value, x.T, strict=True)], axis=1)
        high = low + 1
        left, right = self._gaps(x, low, high)
        seen = np.zeros((rows, k), bool)
        live = np.arange(rows)
        while len(live):
            up = right <= left
            shown = np.zeros((len(live), k), bool)
            shown[np.arange(len(live))[:, None], self.number[self.dims, np.where(up, high, low)]] = True
            shown &= ~seen
            seen |= shown
            at, of = np.nonzero(shown)
            apart = x[at] - self.centroids[of]
            exact += len(at)
            distance = np.full((len(live), k), MAX_LONG)
            distance[at, of] = np.einsum("ij,ij->i", apart, apart)
            least = distance.argmin(axis=1)
            reached = distance[np.arange(len(live)), least]
            better = (reached < best[live]) | ((reached == best[live]) & (least < number[live]))
            best[live[better]], number[live[better]] = reached[better], least[better]
            low, high = low - ~up, high + up
            left, right = self._gaps(x, low, high)
            frontier = np.minimum(left, right)
            on = (np.einsum("ij,ij->i", frontier, frontier) <= best[live]) & ~seen.all(axis=1)
            live, x, low, high, left, right, seen = live[on], x[on], low[on], high[on], left[on], right[on], seen[on]
        return number, best, exact


def _rows(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, batch.num_rows, CHUNK):
        part = batch.column("x").slice(at, CHUNK)
        yield at, part.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster int, distance long) of ``vectors(vec_id, x)``."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids)
        for batch in batches:
            for at, x in _rows(batch, dim):
                number, distance, _ = lists.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(at, CHUNK), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters keep their centroid."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, total, count = SortedLists(centroids), np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _rows(batch, dim):
                number, _, _ = lists.nearest(x)
                order = np.argsort(number, kind="stable")
                there, first = np.unique(number[order], return_index=True)
                total[there] += np.add.reduceat(x[order], first, axis=0)
                count += np.bincount(number, minlength=k)
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = vectors.mapInArrow(run, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("i", "s"))
    wide = sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = centroids.copy()
    for r in wide.collect():
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int, order: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector that takes part.

    ``order`` is an expression over vec_id: the k rows that are first in it start the clusters 0, 1, ... Then ``rounds``
    rounds assign all vectors and move the centroids, and all are assigned once more.
    """
    rows = materialize(integers(vectors, dim, id_col, vector_col), "vectors")
    first = rows.where("vec_id is not null").select(order.alias("o"), "x").orderBy("o", "x").limit(k).collect()
    if not first:
        first = rows.orderBy("x").limit(1).select("x").collect()
    if not first:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _means(rows, centroids)
    placed = materialize(assign(rows, centroids), "placed")
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    long = lambda n: n if n <= MAX_LONG else None
    told = [(c, long(s), long(sum(sums.values())), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    # One row a cluster, however many vectors there are.
    per = placed.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
