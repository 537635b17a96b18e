"""Centroid clustering in whole numbers, with centroids filtered by n-simplex projection.

A component x becomes floor(1024 * x), so sums, centroids and squared distances are exact. Several pivots (the starting
centroids, without those that lie in the space of the others) span a simplex. The distances of a vector to the pivots are
worked out once; they place it as the apex over that simplex: coordinates along the simplex and a height over it. Two apexes'
Euclidean distance is a lower bound of the vectors' distance, and with one height turned over it is an upper bound. In each
round a task takes the centroids (a few vectors, by broadcast) and compares a vector exactly only with those whose lower bound
does not pass the least upper bound, with a margin for rounding. It gives back sums per cluster, which Spark adds up.

Vectors that are null, of another length than asked for, or with null or non-finite components are left out. Start: the
vectors whose sha256 of `3:<id>` is smallest, equal hashes by their components, null ids last; with fewer vectors than
centroids there are fewer centroids. Equal distances go to the smaller number; a centroid without vectors stays. Repeated rows
count each time; empty tables, or none that is kept, give no rows. Vectors with a component beyond `narrow` are compared with
all centroids as Python numbers; a distance or sum beyond 64 bits is null. Columns other than the two named are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import shelved, with_columns, with_fields
from assayline.session import settle

SCALE, SIZE, CENTROIDS, ROUNDS, SEED = 1024, 64, 8, 10, "3"
ROWS = 1 << 13
#: Sums travel in parts of 18 digits.
DIGITS = 10**18
#: Share of a vector's length by which bounds may be off through rounding.
MARGIN = 1e-6
LONG = 1 << 63


def narrow(size: int) -> int:
    """Components below this have squared distances that fit in 62 bits; 2^27 for 64 components."""
    return 1 << (62 - (size - 1).bit_length()) // 2 - 1


@dataclass
class Simplex:
    """Pivots as rows; `base` has orthonormal rows that span their differences from the first one."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, pivots: np.ndarray) -> Simplex:
        """Over the pivots that are not in the space of those before them; one at least."""
        pivots = pivots.astype(np.float64)
        kept, base = [0], []
        for i in range(1, len(pivots)):
            x = pivots[i] - pivots[0]
            rest = x - sum((b * (b @ x) for b in base), np.zeros_like(x))
            rest -= sum((b * (b @ rest) for b in base), np.zeros_like(x))
            if np.linalg.norm(rest) > 1e-3 * max(np.linalg.norm(x), 1.0):
                kept.append(i)
                base.append(rest / np.linalg.norm(rest))
        return cls(pivots[kept], np.array(base).reshape(len(base), pivots.shape[1]))

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates of the vectors with these squared distances to the pivots (a row each); the last is the height."""
        corners = (self.pivots - self.pivots[0]) @ self.base.T  # of the simplex, the first at the origin
        if len(corners) == 1:
            return np.sqrt(distances)
        # |v - p0|^2 - |v - pi|^2 = 2 v.ci - |ci|^2, with v along the simplex
        right = (distances[:, :1] - distances[:, 1:] + (corners[1:] ** 2).sum(1)) / 2
        along = np.linalg.solve(corners[1:], right.T).T
        height = np.sqrt(np.maximum(distances[:, 0] - (along**2).sum(1), 0))
        return np.column_stack([along, height])

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Apexes of vectors, by way of their distances to the pivots."""
        x = vectors.astype(np.float64)
        return self.apexes(np.stack([((x - p) ** 2).sum(1) for p in self.pivots], axis=1))


def possible(apexes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each vector: lower bound at most the least upper bound."""
    along = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
    lower = np.sqrt(along + (apexes[:, None, -1] - centres[None, :, -1]) ** 2)
    upper = np.sqrt(along + (apexes[:, None, -1] + centres[None, :, -1]) ** 2)
    slack = MARGIN * (1 + np.linalg.norm(apexes, axis=1) + np.linalg.norm(centres, axis=1).max())
    return lower <= (upper.min(axis=1) + slack)[:, None]


def may_be_nearest(vectors: np.ndarray, apexes: np.ndarray, simplex: Simplex | None, centroids: np.ndarray) -> np.ndarray:
    """Which centroids have to be compared with each vector; wide vectors with all, and wide centroids with all."""
    may = np.ones((len(vectors), len(centroids)), bool)
    small = np.abs(centroids).max(axis=1) < narrow(centroids.shape[1])
    if vectors.dtype != object and simplex is not None and small.any():
        may[:, small.astype(bool)] = possible(apexes, simplex.place(centroids[small.astype(bool)]))
    return may


def nearest(vectors: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of the nearest centroid of each vector, exactly, and how many distances that took."""
    kind = np.int64 if vectors.dtype != object and np.abs(centroids).max() < narrow(centroids.shape[1]) else object
    vectors = vectors.astype(kind)
    best, at, taken = np.zeros(len(vectors), kind), np.full(len(vectors), -1, np.int32), 0
    for k, centroid in enumerate(centroids.astype(kind)):
        rows = np.flatnonzero(may[:, k])
        taken += len(rows)
        distance = ((vectors[rows] - centroid) ** 2).sum(1)
        closer = ((at[rows] < 0) | (distance < best[rows])).astype(bool)
        best[rows[closer]], at[rows[closer]] = distance[closer], k
    return at, best, taken


def whole(components: list[float]) -> list[int]:
    """floor(1024 * x) of doubles of any size."""
    return [int(np.floor(SCALE * x)) if abs(x) < 2.0**52 else int(x) * SCALE for x in components]


def in_range(x: int) -> int | None:
    return int(x) if -LONG <= x < LONG else None


def kept_vectors(df: DataFrame, size: int) -> DataFrame:
    """(vec_id, wide, vector, large): the rows that count, as whole numbers in `vector`, or, where a component passes `narrow`, as
    the doubles they are in `large`."""
    df = shelved(df, ("vec_id", "embedding"))[0].select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = float(narrow(size) // SCALE)
    wide = F.exists("embedding", lambda x: F.abs(x) >= most)
    numbers = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * F.when(F.abs(x) < most, x)))
    return df.where((F.size("embedding") == size) & good).select(
        "vec_id", wide.alias("wide"), F.when(~wide, numbers).alias("vector"), F.when(wide, F.col("embedding")).alias("large"))


def starting(kept: DataFrame, count: int) -> np.ndarray:
    """The first vectors by hash of their id, `count` rows at most."""
    order = F.sha2(F.concat(F.lit(SEED + ":"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), F.coalesce("vector", F.lit([]).cast("array<long>")), "large").limit(count).collect()
    return np.array([whole(r.large) if r.wide else list(r.vector) for r in rows], object)


def _vectors(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the narrow rows, as 64-bit numbers, and of the wide ones, as Python numbers."""
    wide = batch.column("wide").to_numpy(zero_copy_only=False)
    if (~wide).any():
        yield np.flatnonzero(~wide), batch.column("vector").filter(pa.array(~wide)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)
    if wide.any():
        yield np.flatnonzero(wide), np.array([whole(x) for x in batch.column("large").filter(pa.array(wide)).to_pylist()], object)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def placed(kept: DataFrame, simplex: Simplex | None, size: int) -> DataFrame:
    """The rows with `apex array<double>`, their cached place over the simplex; wide rows, or all without one, get zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            apex = np.zeros((batch.num_rows, len(simplex.pivots) if simplex else 1))
            for at, x in _vectors(batch, size):
                if simplex and x.dtype != object:
                    apex[at] = simplex.place(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32)), pa.array(apex.reshape(-1)))
            yield with_columns(batch, apex=lists)

    return kept.mapInArrow(run, with_fields(kept, apex="array<double>"))


def _assigned(batch: pa.RecordBatch, simplex: Simplex | None, centroids: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places, vectors, clusters, distances) of the rows of a batch."""
    apexes = batch.column("apex").flatten().to_numpy().reshape(batch.num_rows, -1)
    for at, x in _vectors(batch, size):
        yield at, x, *nearest(x, may_be_nearest(x, apexes[at], simplex, centroids), centroids)[:2]


def cluster_sums(rows: DataFrame, simplex: Simplex | None, centroids: np.ndarray, size: int) -> dict[int, tuple[list[int], int]]:
    """Per cluster with vectors: sums of the components and number of vectors. A row per cluster, component and 18 digits
    reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * size for _ in centroids], [0] * len(centroids)
        for batch in _parts(batches):
            for _, x, cluster, _ in _assigned(batch, simplex, centroids, size):
                for k in np.unique(cluster).tolist():
                    of = x[cluster == k]
                    sums[k] = [a + int(b) for a, b in zip(sums[k], of.sum(0), strict=True)]
                    counts[k] += len(of)
        out = []
        for k, n in enumerate(counts):
            for at, v in enumerate(sums[k] if n else ()):
                sign, v, part = (-1 if v < 0 else 1), abs(v), 0
                while v or not part:
                    v, low = divmod(v, DIGITS)
                    out.append((k, at, part, sign * low, n))
                    part += 1
        if out:
            names = ("cluster", "at", "part", "sum", "n")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=names)

    parts = rows.mapInArrow(run, "cluster long, at long, part long, sum long, n long")
    total = parts.groupBy("cluster", "at", "part").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"), F.sum("n").alias("n")).collect()
    out: dict[int, tuple[list[int], int]] = {}
    for r in sorted(total, key=lambda r: r.part):  # part 0 has all vectors of the cluster
        out.setdefault(r.cluster, ([0] * size, r.n))[0][r.at] += int(r["sum"]) * DIGITS**r.part
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """Of df (vec_id, embedding): (vec_id, cluster, distance) of the kept vectors, settled, and the final centroids."""
    kept = settle(kept_vectors(df, size), "vectors")
    centroids = starting(kept, count)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    small = np.array([max(map(abs, c)) < narrow(size) for c in centroids.tolist()])
    simplex = Simplex.over(centroids[small]) if small.any() else None
    rows = settle(placed(kept, simplex, size), "apexes")
    for _ in range(rounds):
        for k, (sums, n) in cluster_sums(rows, simplex, centroids, size).items():
            centroids[k] = [s // n for s in sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            number, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for at, _, cluster, far in _assigned(batch, simplex, centroids, size):
                number[at], distance[at] = cluster, far
            far = pa.array([in_range(d) for d in distance.tolist()], pa.int64())
            yield with_columns(batch.select(["vec_id"]), cluster=pa.array(number), distance=far)

    return settle(rows.mapInArrow(run, with_fields(rows.select("vec_id"), cluster="int", distance="long")), "clusters"), centroids


def clustered(df: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept vectors."""
    done, centroids = cluster(df, count, rounds, size)

    def total(of: Column) -> Column:
        return F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum(of.cast("decimal(38,0)"))).try_cast("long")

    sums = {r.cluster: r.inertia for r in done.groupBy("cluster").agg(total(F.col("distance")).alias("inertia")).collect()}
    known = [v for v in sums.values() if v is not None]
    everything = in_range(sum(known)) if len(known) == len(sums) else None
    table = df.sparkSession.createDataFrame(
        [(k, sums.get(k), everything, digest(c)) for k, c in enumerate(centroids)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
