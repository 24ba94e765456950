"""Centroid clustering of quantised vectors with exact integer results.

Vectors become integers and are written in blocks, one row each: the ids and a matrix as bytes. Distances of a block
come from one matrix product, |x|^2 - 2 x.c + |c|^2 in float64, where a bound on the components keeps every term and
every partial sum below 2**53, so that BLAS is exact in any order; vectors and centroids beyond the bound take integers,
of 64 bits while these suffice and of any size otherwise. Sums of clusters are combined by a tree over the blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piecework.llm.common import cut

#: Components are scaled by this before they are floored.
SCALE = 64
#: Integers of so many bits are exact in float64, whatever the order of summing.
EXACT_BITS = 53
#: Vectors of a block.
BLOCK = 4_096
#: Blocks' integer kinds, the narrowest that holds its components; beyond them components travel as decimal text.
KINDS = ("int16", "int32", "int64")
CLUSTERED = "vec_id long, cluster int, distance long"


def small_limit(size: int) -> int:
    """Components up to this, of vector and centroid alike, keep |x|^2 + 2|x.c| + |c|^2 <= 4 * size * limit^2 below 2**53."""
    limit = 1
    while 4 * size * (2 * limit) ** 2 < 1 << EXACT_BITS:
        limit *= 2
    return limit


def floors(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of a float64 matrix as int64, or as objects where a component needs more than 62 bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not len(x) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    # From 2**53 on a float is an integer, so scaling by integers loses nothing and cannot overflow.
    exact = [[int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()]
    return np.array(exact, object)


def encode(vectors: np.ndarray) -> tuple[str, bytes]:
    if vectors.dtype == object:
        return "text", " ".join(map(str, vectors.ravel().tolist())).encode()
    most = int(np.abs(vectors).max(initial=0))
    kind = next(k for k in KINDS if most <= np.iinfo(k).max)
    return kind, vectors.astype(kind).tobytes()


def decode(kind: str, data: bytes, size: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(v) for v in data.split()], object).reshape(-1, size)
    return np.frombuffer(data, kind).reshape(-1, size).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by integers: of 64 bits if no sum can overflow, else of any size."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most * most >= 1 << 63:
        x, c = x.astype(object), c.astype(object)
    else:
        x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the number of the nearest centroid, the smaller of equals, and the squared distance."""
    limit = small_limit(x.shape[1])
    low, near = np.abs(x).max(axis=1) <= limit, np.abs(centroids).max(axis=1) <= limit
    where, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    if low.any() and near.any():
        names = np.flatnonzero(near)
        a, c = x[low].astype(np.float64), centroids[near].astype(np.float64)
        found = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
        best = found.argmin(axis=1)
        where[low], distance[low] = names[best], found[np.arange(len(a)), best].astype(np.int64)
    if low.any() and not near.all():
        names = np.flatnonzero(~near)
        found = squared(x[low], centroids[~near])
        best = found.argmin(axis=1)
        d, at = found[np.arange(len(found)), best], names[best]
        old, was = distance[low], where[low]
        less = (d < old) | ((d == old) & (at < was)) if near.any() else np.ones(len(d), bool)
        less = less.astype(bool)
        where[low], distance[low] = np.where(less, at, was), np.where(less, d, old)
    if not low.all():
        found = squared(x[~low], centroids)
        best = found.argmin(axis=1)
        where[~low], distance[~low] = best, found[np.arange(len(found)), best]
    return where, distance


def sums_by(where: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Sums of the vectors of each cluster, as integers of any size."""
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(k + 1))
    out = np.zeros((k, x.shape[1]), object)
    for i, (a, b) in enumerate(pairwise(edges)):
        if b > a:
            rows = x[order[a:b]]
            # A block's sum fits 64 bits for components of 49 bits.
            wide = rows.dtype == object or int(np.abs(rows).max()) * len(rows) >= 1 << 62
            out[i] = rows.astype(object).sum(axis=0) if wide else [int(v) for v in rows.sum(axis=0)]
    return out


def vector_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """ids, kind, data: the kept vectors of (vec_id, vector) in blocks; a null id is marked in `none`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch["vec_id"], batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            whole = floors(values)
            for a in range(0, len(whole), BLOCK):
                part, own = whole[a : a + BLOCK], ids.slice(a, BLOCK)
                kind, data = encode(part)
                none, keys = np.asarray(own.is_null()), np.asarray(own.fill_null(0)).astype(np.int64)
                row = [pa.array([x]) for x in (keys.tobytes(), none.tobytes(), kind, data)]
                yield pa.RecordBatch.from_arrays(row, ["ids", "none", "kind", "data"])

    return vectors.mapInArrow(run, "ids binary, none binary, kind string, data binary")


def first_centroids(kept: DataFrame, k: int, size: int) -> np.ndarray:
    """The vectors of the k rows whose ids hash lowest; rows of one id by their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "vector").orderBy("key", "vector").limit(k).collect()
    return floors(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), size))


class Totals:
    """What a tree of tasks gathers for each cluster: rows, sums of components, sum of distances."""

    def __init__(self, k: int, size: int):
        self.count, self.sums, self.inertia = np.zeros(k, object), np.zeros((k, size), object), np.zeros(k, object)

    def add(self, x: np.ndarray, centroids: np.ndarray) -> Totals:
        k = len(centroids)
        where, distance = nearest(x, centroids)
        self.count = self.count + np.bincount(where, minlength=k).astype(object)
        self.sums = self.sums + sums_by(where, x, k)
        self.inertia = self.inertia + sums_by(where, distance[:, None], k)[:, 0]
        return self

    def join(self, other: Totals) -> Totals:
        self.count, self.sums, self.inertia = self.count + other.count, self.sums + other.sums, self.inertia + other.inertia
        return self


def totals(blocks: DataFrame, centroids: np.ndarray) -> Totals:
    """Totals over all blocks; k vectors of sums travel, whatever the input."""
    k, size = centroids.shape
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)
    rows = blocks.select("kind", "data").rdd
    add = lambda t, r: t.add(decode(r["kind"], bytes(r["data"]), size), shared.value)
    return rows.treeAggregate(Totals(k, size), add, Totals.join, depth=2)


def moved(centroids: np.ndarray, found: Totals) -> np.ndarray:
    """Centroids at the floored means; those of empty clusters stay."""
    rows = [[int(s) // int(n) for s in sums] if n else [int(v) for v in old] for n, sums, old in zip(found.count, found.sums, centroids, strict=True)]
    most = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if most < 1 << 62 else object).reshape(centroids.shape)


def fit_centroids(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, Totals]:
    """The centroids after `rounds` of Lloyd's algorithm, and the totals of the assignment to them."""
    for _ in range(rounds):
        centroids = moved(centroids, totals(blocks, centroids))
    return centroids, totals(blocks, centroids)


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row for each kept vector.

    Kept are vectors of exactly `size` components, none of them null, NaN or infinite. Rows of one id are vectors of
    their own; null ids are clustered like others and hash as an empty id. With fewer than `k` vectors there are as
    many centroids as vectors; an empty table gives an empty result. Distances and sums that a long cannot hold are
    null, though compared and summed exactly. Other columns are not read.
    """
    x = F.col(vector_col).cast("array<double>")
    fits = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(fits).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"))
    start = first_centroids(kept, k, size)
    blocks = cut(vector_blocks(kept, size), "vector-blocks")
    if not len(start):
        return kept.sparkSession.createDataFrame([], f"{CLUSTERED}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, found = fit_centroids(blocks, start, rounds)
    shared = blocks.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, none, kind, data in zip(*(batch[c] for c in ("ids", "none", "kind", "data")), strict=True):
                where, distance = nearest(decode(kind.as_py(), data.as_py(), size), shared.value)
                keys = pa.array(np.frombuffer(ids.as_py(), np.int64), mask=np.frombuffer(none.as_py(), bool))
                columns = [keys, pa.array(where, pa.int32()), pa.array([_long(d) for d in distance.tolist()], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    def digest(c: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()

    whole = _long(int(sum(found.inertia)))
    each = [(i, _long(int(n)), digest(c)) for i, (n, c) in enumerate(zip(found.inertia, centroids, strict=True))]
    # k rows, so they are broadcast.
    names = blocks.sparkSession.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string")
    rows = blocks.mapInArrow(run, CLUSTERED).join(F.broadcast(names), "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256")
