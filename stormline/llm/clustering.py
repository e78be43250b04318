"""Centroid clustering of integer vectors by tournaments over the bisectors of centroid pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stormline.session import pinned

EXACT = 2.0 ** 53  # whole numbers below this are exact in a double
LONGEST = 2 ** 63 - 1
LIMB = 40  # sums travel as signed parts of so many bits, so that any size of sum is exact
CHUNK = 1024


class Bisectors:
    """Normals and thresholds of all pairs of centroids a < b.

    A vector x is nearer to b than to a exactly when normal . x > threshold, where normal
    is 2 (b - a) and threshold |b|^2 - |a|^2, all whole numbers. Zero favours a, the smaller
    number. Numbers are doubles as long as every sum stays below 2 ** 53, else Python's.
    """

    def __init__(self, centroids: list[list[int]], dim: int):
        self.k = len(centroids)
        whole = np.array(centroids, dtype=object).reshape(self.k, dim)
        a, b = np.triu_indices(self.k, 1)
        normals, squares = 2 * (whole[b] - whole[a]), (whole * whole).sum(1)
        thresholds = squares[b] - squares[a]
        self.place = np.zeros((self.k, self.k), dtype=np.int64)
        self.place[a, b] = np.arange(len(a))
        self.largest = max((abs(int(v)) for v in whole.ravel()), default=0)
        self.whole = whole, normals, thresholds
        self.doubles = tuple(part.astype(np.float64) for part in self.whole)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row of ``x`` (doubles that are whole), and the squared distance."""
        numbers, distances = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for first in range(0, len(x), CHUNK):
            part = x[first:first + CHUNK]
            reach = 2.0 * max(float(np.abs(part).max(initial=0)), float(self.largest))
            if part.shape[1] * reach * reach < EXACT:
                centroids, normals, thresholds = self.doubles
            else:
                part = whole_numbers(part)
                centroids, normals, thresholds = self.whole
            winner = self._play(part, normals, thresholds)
            numbers.append(winner)
            distances.append(((part - centroids[winner]) ** 2).sum(1))
        return np.concatenate(numbers), np.concatenate(distances)

    def _play(self, x: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
        """k - 1 sign tests a row, neighbours against neighbours, so the smaller number always stands left."""
        left = np.broadcast_to(np.arange(self.k), (len(x), self.k))
        while left.shape[1] > 1:
            pairs = left.shape[1] // 2
            a, b = left[:, 0:2 * pairs:2], left[:, 1:2 * pairs:2]
            if left.shape[1] == self.k:  # the first round is the same for all rows
                at = self.place[a[0], b[0]]
                side = x @ normals[at].T - thresholds[at]
            else:
                at = self.place[a, b]
                side = (x[:, None, :] * normals[at]).sum(-1) - thresholds[at]
            left = np.concatenate([np.where(side > 0, b, a), left[:, 2 * pairs:]], axis=1)
        return left[:, 0].astype(np.int64)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """The same values as Python's whole numbers."""
    return np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)


def quantised(vectors: pa.ListArray, scale: int, dim: int) -> np.ndarray:
    """floor(scale * component) of every vector, as doubles, which hold it exactly."""
    return np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)


def _sums(vectors: DataFrame, bisectors: Bisectors, scale: int, dim: int) -> dict[tuple[int, int], int]:
    """Per cluster and component the exact sum over all vectors, and at component -1 the count.

    Each task gives one partial sum per cluster and component, and Spark adds them up: what
    comes to the driver is bounded by clusters and components.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = quantised(batch.column(0), scale, dim)
            numbers, _ = bisectors.nearest(x)
            fits = float(np.abs(x).max(initial=0)) * len(x) < EXACT
            for number in np.unique(numbers):
                own = x[numbers == number]
                parts = (own if fits else whole_numbers(own)).sum(0)
                for place, value in [(-1, len(own)), *enumerate(parts)]:
                    totals[number, place] = totals.get((number, place), 0) + int(value)
        rows = []
        for (number, place), value in totals.items():
            sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
            while rest or not limb:
                rows.append((int(number), place, limb, sign * (rest & ((1 << LIMB) - 1))))
                rest, limb = rest >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            names=["cluster", "place", "limb", "part"])

    found = vectors.select("vector").mapInArrow(add, "cluster int, place int, limb int, part long")
    sums: dict[tuple[int, int], int] = {}
    for row in found.groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part")).collect():
        at = row["cluster"], row["place"]
        sums[at] = sums.get(at, 0) + (row["part"] << (LIMB * row["limb"]))
    return sums


@dataclass
class Clusters:
    centroids: list[list[int]]
    assigned: DataFrame  # id, cluster, distance

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
                      id_col: str = "vec_id", vector_col: str = "embedding") -> Clusters:
    """Clusters of the vectors with exactly ``dim`` components, none null, NaN or infinite; other rows have no result.

    A component x becomes the whole number floor(scale * x). The first centroids are the k
    vectors with the smallest SHA-256 of "seed:id". A round assigns every vector to its
    nearest centroid by squared Euclidean distance (ties: the smaller number) and replaces
    each centroid with vectors by their componentwise floor(sum / count). A last pass assigns
    once more, to the final centroids. Everything is exact: normals and thresholds of all
    pairs of centroids are computed before a pass, k - 1 sign tests eliminate the losers, and
    the winner's distance is taken from whole numbers.

    Memory: the normals hold k (k - 1) / 2 * dim numbers in every task, a bound of the
    parameters. Each pass reads the vectors where they lie; only partial sums move, so a
    cluster that holds most vectors, or very many equal vectors, weighs on no single task.

    Fewer than k vectors give as many centroids. Null identifiers count as empty text in the
    hash; of rows with equal hashes the smaller vector goes first. Repeated rows are vectors of
    their own. A distance beyond a long is null. An empty table gives no centroids and no rows.
    """
    whole = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    rows = pinned(rows.where((F.size("vector") == dim) & whole))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    centroids = [[int(v) for v in quantised(pa.array([list(r["vector"])]), scale, dim)[0]] for r in first]
    for _ in range(rounds if centroids else 0):
        sums = _sums(rows, Bisectors(centroids, dim), scale, dim)
        centroids = [[sums[c, d] // sums[c, -1] for d in range(dim)] if (c, -1) in sums else old
                     for c, old in enumerate(centroids)]
    bisectors = Bisectors(centroids, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, distances = bisectors.nearest(quantised(batch.column(1), scale, dim))
            near = [int(d) if d <= LONGEST else None for d in distances]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, type=pa.int32()), pa.array(near, type=pa.int64())],
                names=["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return Clusters(centroids, rows.mapInArrow(assign, f"id {kind}, cluster int, distance long"))


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2,
              id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per clustered vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    cluster_inertia sums the distances of the cluster, inertia those of all vectors; each is
    null if it is beyond a long. See ``centroid_clusters`` for the rules.
    """
    found = centroid_clusters(vectors, k, rounds, dim, scale, seed, id_col, vector_col)
    spark = vectors.sparkSession
    assigned = pinned(found.assigned)
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("part"),
                                           (F.count("distance") < F.count(F.lit(1))).alias("open"))
    sums = {r["cluster"]: None if r["open"] else int(r["part"]) for r in sums.collect()}  # at most k rows
    total = None if None in sums.values() else sum(sums.values())

    def fitting(value: int | None) -> int | None:
        return value if value is not None and value <= LONGEST else None

    facts = [(c, fitting(sums.get(c, 0)), fitting(total), digest) for c, digest in enumerate(found.digests())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
