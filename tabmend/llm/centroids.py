"""Centroid clustering (k-means over integers) whose nearest centroids are found by Orchard's search.

Every centroid has a list of the other centroids, nearest first.  A vector starts at some centroid and
walks along its list; once it meets a closer centroid it goes on along that one's list, passing over
those already seen.  By the triangle inequality nothing beyond twice the vector's distance can be closer,
so the walk stops there - strictly beyond, as one at exactly twice the distance may be as close.

All arithmetic is exact: components are integers, distances are squared sums of them, and new centroids
are floors of exact means, so a result depends neither on how rows lie in partitions nor on the order of sums.
Tasks walk whole batches at once and send one row of sums for each centroid they have met.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import Workspace, named, shipped

shipped(__name__)

COMPONENTS, SCALE = 64, 1024
CLUSTERS, ROUNDS, SEED = 8, 10, "3"
#: Vectors that walk together, and marks (vectors times centroids) that they need at most.
BATCH, MARKS = 4096, 1 << 24


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """(id, v): the vectors of exactly ``components`` finite numbers, scaled and floored to integers."""
    v = F.transform(named(vector_col), lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    df = vectors.select(named(id_col).alias("id"), v.alias("v"))
    df = df.filter((F.size("v") == components) & F.forall("v", fine))
    return df.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def start_order(id_: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)


@dataclass
class Centroids:
    """Centroids and, for each, all of them by distance: itself, then its neighbours, nearest first."""

    points: np.ndarray  # k x components, whole numbers
    near: np.ndarray  # k x k numbers of centroids
    apart: np.ndarray  # k x k squared distances, sorted

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        apart = np.stack([((points - p) ** 2).sum(axis=1) for p in points])
        near = np.argsort(apart, axis=1, kind="stable")
        # equal centroids lie at distance 0; the walk starts behind the centroid itself
        own = np.arange(len(points))[:, None]
        near = np.concatenate((own, near[near != own].reshape(len(points), -1)), axis=1)
        return cls(points, near, np.take_along_axis(apart, near, axis=1))

    @property
    def batch(self) -> int:
        return max(1, min(BATCH, MARKS // len(self.points)))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (the smaller number of equals), its squared distance,
        and how many distances were computed."""
        n, k = len(v), len(self.points)
        best = np.zeros(n, np.int64)
        dist = ((v - self.points[0]) ** 2).sum(axis=1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.ones(n, np.int64)  # the place in the list of the best centroid
        walk = np.arange(n) if k > 1 else np.arange(0)
        looked = n
        while len(walk):
            b, p = best[walk], at[walk]
            on = self.apart[b, p] <= 4 * dist[walk]  # beyond that nothing is as close
            walk, b, p = walk[on], b[on], p[on]
            other = self.near[b, p]
            fresh = ~seen[walk, other]
            seen[walk, other] = True
            at[walk] = p + 1
            new, other = walk[fresh], other[fresh]
            looked += len(new)
            d = ((v[new] - self.points[other]) ** 2).sum(axis=1)
            closer = (d < dist[new]) | ((d == dist[new]) & (other < best[new]))
            new = new[closer]
            best[new], dist[new], at[new] = other[closer], d[closer], 1
            walk = walk[at[walk] < k]
        return best, dist, looked


def _vectors(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def _sums(centroids: Centroids, components: int):
    """For mapInArrow: rows (id, v) to one row of sums per centroid and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids.points)
        sums, count = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, centroids.batch):
                v = _vectors(batch.column(0).slice(at, centroids.batch), components)
                best, _, _ = centroids.nearest(v)
                count += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                first = np.flatnonzero(np.diff(best[order], prepend=-1))
                sums[best[order][first]] += np.add.reduceat(v[order], first, axis=0)
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(count[met]),
             pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1, dtype=np.int32) * components), pa.array(sums[met].ravel()))],
            names=["cluster", "n", "sums"],
        )

    return work


def moved(rows: DataFrame, centroids: Centroids, components: int) -> Centroids:
    """The centroids after one round; those without vectors stay."""
    parts = rows.select("v").mapInArrow(_sums(centroids, components), "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(components)]
    )
    points = centroids.points.copy()
    for row in total.collect():  # at most one row for each centroid
        points[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(components)]
    return Centroids.of(points)


def _assigned(centroids: Centroids, components: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, centroids.batch):
                part = batch.slice(at, centroids.batch)
                best, dist, _ = centroids.nearest(_vectors(part.column(1), components))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best.astype(np.int32)), pa.array(dist)], names=["id", "cluster", "distance"])

    return work


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = SEED,
) -> DataFrame:
    """Per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (array of whole numbers).

    Kept are vectors of exactly ``components`` numbers, none null or not finite; each number x becomes
    floor(scale * x).  The first centroids are the vectors of the smallest SHA-256 of ``<seed>:<id>``
    (a null id is empty text), of rows with one id those of the smaller components; fewer vectors than
    ``clusters`` make as many centroids.  Equal vectors may start several centroids: the smallest number takes
    all their vectors, the others stay empty and where they are.  Rows that repeat count each time.  An
    empty table gives no rows.  Distances are longs, so squared distances, times 4, must
    stay below 2**63: components of up to about 10**5 in 64 dimensions; larger ones are an error, not a wrong result.

    The driver holds the centroids alone, and each task their sorted lists: ``clusters`` squared numbers, which
    suits thousands of centroids."""
    spark = vectors.sparkSession
    space = Workspace(spark)
    kind = vectors.select(named(id_col)).schema[0].dataType.simpleString()
    rows = space.stored(whole_vectors(vectors, id_col, vector_col, components, scale), "vectors")
    far = rows.agg(F.max(F.greatest(F.abs(F.array_min("v")), F.abs(F.array_max("v"))))).first()[0]
    if far is None:
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    if 16 * components * far**2 >= 1 << 63:
        raise ValueError(f"components up to {far} have squared distances beyond a long")
    first = rows.select("v", start_order(F.col("id"), seed).alias("h")).orderBy("h", "v").limit(clusters).collect()
    centroids = Centroids.of(np.array([r["v"] for r in first], np.int64))
    for _ in range(rounds):
        centroids = moved(rows, centroids, components)
    told = rows.mapInArrow(_assigned(centroids, components), f"id {kind}, cluster int, distance long")
    told = space.stored(told, "assigned")
    sums = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    inertia = sum(sums.values())
    each = spark.createDataFrame(
        [(c, s, centroids.points[c].tolist()) for c, s in sums.items()], "c_ int, cluster_inertia long, centroid array<long>"
    )
    told = told.join(F.broadcast(each), F.col("cluster") == F.col("c_"))  # a row for each centroid
    return told.select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid"
    )
