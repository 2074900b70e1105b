"""Centroid clustering in whole numbers, with Ptolemaic lower bounds from fixed pivots.

Of four points q, c, p, s of Euclidean space Ptolemy's inequality says
d(q, c) d(p, s) >= |d(q, p) d(c, s) - d(q, s) d(c, p)|. The pivots p, s are the starting centroids;
their distances to every vector are stored with the vectors once, those to the centroids are
a few numbers a round. A centroid whose bound, rounded down, lies above a distance already known is
skipped; every other one is measured exactly, so the clusters are those of a full comparison.

Vectors stay in files of the shared folder. A round is one job over them: each task adds up its vectors
by cluster, Spark adds the sums, and the driver gets `clusters` x `width` numbers, whatever the input.

Defined results: vectors that are null, of another width, or hold a null or non-finite component are left out.
Any finite component is exact: vectors or centroids beyond `SMALL` are compared in unbounded whole
numbers; a distance or a sum of distances beyond 64 bits is null. Repeated rows are vectors of their own; equal ids
order by vector. A null id is hashed as an empty one. Fewer vectors than clusters make as many
clusters as vectors, none makes an empty result. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.llm.common import cut

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 8, 10, 64, 1024, 3
#: Up to this size of all components, squared distances of `WIDTH` components are exact in doubles.
SMALL = 1 << 22
#: Relative allowance for rounding, far above the few units of 2^-53 that the bounds can be off.
SLACK = 2.0 ** -46
#: Whole numbers travel as digits of so many bits.
_DIGIT = 40
_LONGEST = (1 << 63) - 1


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), also where the product is no double."""
    return int(x) * scale if abs(x) >= 2.0 ** 60 else math.floor(x * scale)


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the rows whose components are small, as doubles; which rows those are."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    return y, (np.abs(y) <= SMALL).all(axis=1)


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def _root(square: int) -> float:
    try:
        return math.sqrt(square)
    except OverflowError:
        return math.inf


class Pivots:
    """Fixed points and the pairs of them that give bounds: each point with the one farthest from it."""

    def __init__(self, points: list[list[int]]):
        self.points = points
        gaps = [[_root(squared(a, b)) for b in points] for a in points]
        far = {tuple(sorted((i, max(range(len(points)), key=row.__getitem__)))) for i, row in enumerate(gaps)}
        self.pairs = sorted((i, j) for i, j in far if 0 < gaps[i][j] < math.inf)
        self.gaps = [gaps[i][j] for i, j in self.pairs]

    def distances(self, x: np.ndarray, scale: int) -> np.ndarray:
        """Of every row to every pivot, each within a unit of 2^-51 of its value."""
        y, small = whole_numbers(x, scale)
        out = np.empty((len(x), len(self.points)))
        for j, point in enumerate(self.points):
            if max(map(abs, point), default=0) <= SMALL:
                with np.errstate(over="ignore", invalid="ignore"):
                    out[:, j] = np.sqrt(np.square(y - np.array(point, dtype=float)).sum(axis=1))
                exact = np.flatnonzero(~small)
            else:
                exact = range(len(x))
            for i in exact:
                out[i, j] = _root(squared([_whole(v, scale) for v in x[i].tolist()], point))
        return out

    def bounds(self, rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the squared distances, rounded down; 0 where a pair says nothing."""
        low = np.zeros((len(rows), len(centroids)))
        with np.errstate(over="ignore", invalid="ignore"):
            for (p, s), gap in zip(self.pairs, self.gaps):
                a = rows[:, p, None] * centroids[None, :, s]
                b = rows[:, s, None] * centroids[None, :, p]
                np.fmax(low, (np.abs(a - b) - SLACK * (a + b)) / gap, out=low)
            square = low * low * (1 - SLACK)
            return np.where(np.isfinite(square), square, 0.0)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: list[list[int]], pivots: Pivots,
            scale: int = SCALE) -> tuple[np.ndarray, list[int], int]:
    """Number of the nearest centroid of each row (the smaller of equals), the squared distances, and how many were measured."""
    of_centroids = np.array([[_root(squared(c, p)) for p in pivots.points] for c in centroids]).reshape(len(centroids), -1)
    low = pivots.bounds(to_pivots, of_centroids)
    y, small = whole_numbers(x, scale)
    if any(abs(v) > SMALL for c in centroids for v in c):
        small = np.zeros(len(x), dtype=bool)
    cluster = low.argmin(axis=1)
    best: list[int] = [0] * len(x)
    rows = np.flatnonzero(small)
    measured = 0
    if len(rows):
        table = np.array(centroids, dtype=float)
        y, low_, first = y[rows], low[rows], cluster[rows]
        near, at = np.square(y - table[first]).sum(axis=1), first.copy()
        measured += len(rows)
        for j in range(len(centroids)):
            left = np.flatnonzero((first != j) & (low_[:, j] <= near))
            d = np.square(y[left] - table[j]).sum(axis=1)
            measured += len(left)
            better = (d < near[left]) | ((d == near[left]) & (j < at[left]))
            near[left[better]], at[left[better]] = d[better], j
        cluster[rows] = at
        for i, d in zip(rows.tolist(), near.astype(np.int64).tolist()):
            best[i] = d
    for i in np.flatnonzero(~small).tolist():
        own, bounds, first = [_whole(v, scale) for v in x[i].tolist()], low[i].tolist(), int(cluster[i])
        near_, at_ = squared(own, centroids[first]), first
        measured += 1
        for j, bound in enumerate(bounds):
            if j != first and bound <= near_:  # a float and a whole number compare exactly
                measured += 1
                near_, at_ = min((near_, at_), (squared(own, centroids[j]), j))
        best[i], cluster[i] = near_, at_
    return cluster, best, measured


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.float64)


def digits(value: int) -> list[int]:
    out = []
    while not -(1 << _DIGIT) < value < 1 << _DIGIT:
        out.append(value & ((1 << _DIGIT) - 1))
        value >>= _DIGIT
    return [*out, value]


def _sums(table: DataFrame, centroids: list[list[int]], pivots: Pivots, width: int, scale: int) -> list[tuple[int, list[int]]]:
    """Number of vectors and their sum, per centroid."""
    k, p = len(centroids), len(pivots.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, large = np.zeros((k, width), np.int64), np.zeros(k, np.int64), {}
        for b in batches:
            x = _matrix(b.column("v"), width)
            cluster, _, _ = nearest(x, _matrix(b.column("pivots"), p), centroids, pivots, scale)
            y, small = whole_numbers(x, scale)
            count += np.bincount(cluster, minlength=k)
            rows = np.flatnonzero(small)
            order = rows[np.argsort(cluster[rows], kind="stable")]
            if len(order):
                own = cluster[order]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                total[own[first]] += np.add.reduceat(y[order].astype(np.int64), first, axis=0)
            for i in np.flatnonzero(~small):
                mine = large.setdefault(int(cluster[i]), [0] * width)
                large[int(cluster[i])] = [a + _whole(v, scale) for a, v in zip(mine, x[i].tolist())]
        out = [(j, -1, 0, int(count[j])) for j in range(k) if count[j]]
        for j in range(k):
            whole = [a + b for a, b in zip(total[j].tolist(), large.get(j, [0] * width))]
            out += [(j, i, n, d) for i, v in enumerate(whole) for n, d in enumerate(digits(v)) if d]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                                             names=["cluster", "place", "digit", "total"])

    parts = (table.select("v", "pivots").mapInArrow(run, "cluster int, place int, digit int, total bigint")
             .groupBy("cluster", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    counts, sums = [0] * k, [[0] * width for _ in range(k)]
    for r in parts.collect():  # clusters x (width + 1) numbers of a few digits
        if r["place"] < 0:
            counts[r["cluster"]] = int(r["total"])
        else:
            sums[r["cluster"]][r["place"]] += int(r["total"]) << (_DIGIT * r["digit"])
    return list(zip(counts, sums))


def usable(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", width: int = WIDTH) -> DataFrame:
    """(id, v) of the vectors with `width` finite components."""
    whole = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(whole, F.lit(False)).alias("fit")).where("fit").drop("fit")


def cluster(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector."""
    spark = vectors.sparkSession
    fit = usable(vectors, vector, key, width)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    start = [r["v"] for r in fit.select("id", "v", mark.alias("mark")).orderBy("mark", "id", "v").limit(clusters).collect()]
    kind = vectors.schema[key].dataType.simpleString()
    if not start:
        return spark.createDataFrame([], f"{key} {kind}, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    centroids = [[_whole(x, scale) for x in row] for row in start]
    pivots = Pivots(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pivots.distances(_matrix(b.column("v"), width), scale)
            rows = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), rows], names=["id", "v", "pivots"])

    table = cut(fit.mapInArrow(measure, f"id {kind}, v array<double>, pivots array<double>"), "vectors")
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old
                     for old, (n, sums) in zip(centroids, _sums(table, centroids, pivots, width, scale))]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, best, _ = nearest(_matrix(b.column("v"), width), _matrix(b.column("pivots"), len(pivots.points)),
                                   centroids, pivots, scale)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(own, pa.int32()), pa.array([d if d <= _LONGEST else None for d in best], pa.int64())],
                names=["id", "cluster", "distance"])

    assigned = cut(table.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"), "assigned")
    known = F.count("*") == F.count("distance")
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(
        F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")).collect()}  # a row per cluster

    def short(value) -> int | None:
        return int(value) if value is not None and value <= _LONGEST else None

    every = short(sum(sums.values())) if None not in sums.values() else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(j, short(v), every, names[j]) for j, v in sorted(sums.items())],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return (assigned.join(F.broadcast(about), "cluster")  # a row per cluster
            .select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
