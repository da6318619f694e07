"""Centroid clustering in whole numbers, with centroids screened by the norms of segments.

Components become integers, floor(scale * x). Beside them a vector keeps the norms of its segments in single
precision, an eighth of its size. By Cauchy and Schwarz a segment's difference is no shorter than that of the
norms, so the squared differences of norms, summed over segments and rounded down by more than the precision,
are a lower bound of the squared distance. The centroid of the least bound gets the exact distance; others get
theirs only where their bound is not above it. Distances, sums and means are exact integers.

A round reads the stored table once; each task gives one row for each centroid and component, sums over these
rows are taken before and after one shuffle, and the driver gets k * (components + 1) numbers. The centroids, as
many, go to all tasks. Vectors are never shuffled.

Defined cases: null vectors, those of another length and those with a null or non-finite component take no part;
the first centroids are distinct rows, of equal ids in the order of their components, and never rows without an id,
which are clustered like others; with fewer than ``k`` such rows there are as many centroids; equal vectors are
separate rows; an empty table, or one without a usable id, gives an empty result; other columns are ignored. A component of 2^27 or more after
scaling, whose distances may leave 64 bits, fails the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

CENTROIDS, ROUNDS = 8, 10
SIZE, SCALE = 64, 1024
#: What precedes an id in the hash that chooses the first centroids.
SALT = "3:"
#: Components of a segment.
SEGMENT = 8
LARGEST = 1 << 27
#: More than the relative error of a norm in single precision, and of a sum of their squares.
NORM_ERROR, SUM_ERROR = 2.0**-22, 1e-9


def usable(v: Column, size: int = SIZE) -> Column:
    """Whether a vector takes part."""
    return v.isNotNull() & (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of each row's segments."""
    pad = -x.shape[1] % SEGMENT
    parts = np.pad(x.astype(np.float64), ((0, 0), (0, pad))).reshape(len(x), -1, SEGMENT)
    return np.sqrt((parts * parts).sum(2)).astype(np.float32)


def nearest(x: np.ndarray, short: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the first), its squared distance, and how many exact distances were taken."""
    c = norms(centroids).astype(np.float64)
    bound = np.zeros((len(x), len(c)))
    for s in range(c.shape[1]):
        a, b = short[:, s, None].astype(np.float64), c[None, :, s]
        gap = np.maximum(np.abs(a - b) - NORM_ERROR * (a + b), 0)
        bound += gap * gap
    bound *= 1 - SUM_ERROR
    rows = np.arange(len(x))
    best = bound.argmin(1)
    far = ((x - centroids[best]) ** 2).sum(1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, best] = far
    row, other = np.nonzero(bound <= far[:, None])
    open_ = other != best[row]
    row, other = row[open_], other[open_]
    exact[row, other] = ((x[row] - centroids[other]) ** 2).sum(1)
    at = exact.argmin(1)
    return at, exact[rows, at], len(x) + len(row)


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, short): usable vectors as integers, and the norms of their segments."""
    kind = T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("v array<int>, short array<float>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(scale * np.asarray(b.column("v").flatten(), np.float64).reshape(-1, size))
            if len(x) and np.abs(x).max() >= LARGEST:
                raise OverflowError(f"a component is {LARGEST} or more after scaling: squared distances would leave 64 bits")
            short = norms(x)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.reshape(-1))) for a in (x.astype(np.int32), short)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *lists], names=kind.names)

    kept = vectors.where(usable(F.col("embedding"), size))
    return kept.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, kind)


def _matrix(col: pa.Array, rows: int, kind: type) -> np.ndarray:
    return np.asarray(col.flatten(), kind).reshape(rows, -1)


def seeds(vectors: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The first centroids: the k rows whose ids have the least hashes."""
    by = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = vectors.where(F.col("vec_id").isNotNull()).select(by.alias("by"), "v").orderBy("by", "v").limit(k)
    return np.array([r["v"] for r in first.collect()], np.int64)  # k rows


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: exact floors of their vectors' means; empty ones stay."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), size + 1), np.int64)  # the last column counts
        for b in batches:
            x = _matrix(b.column("v"), b.num_rows, np.int64)
            at, _, _ = nearest(x, _matrix(b.column("short"), b.num_rows, np.float32), centroids)
            np.add.at(sums, at, np.concatenate((x, np.ones((len(x), 1), np.int64)), 1))
        c, d = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(sums[c, d])], names=["cluster", "d", "s"])

    out = centroids.copy()
    got = {(r["cluster"], r["d"]): r["s"] for r in vectors.select("v", "short").mapInArrow(run, "cluster int, d int, s bigint").groupBy("cluster", "d").agg(F.sum("s").alias("s")).collect()}  # k * (size + 1) rows
    for c in range(len(out)):
        if n := got.get((c, size)):
            out[c] = [got.get((c, d), 0) // n for d in range(size)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each row."""
    kind = T.StructType([vectors.schema["vec_id"], *T.StructType.fromDDL("cluster int, distance bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far, _ = nearest(_matrix(b.column("v"), b.num_rows, np.int64), _matrix(b.column("short"), b.num_rows, np.float32), centroids)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(at, pa.int32()), pa.array(far)], names=kind.names)

    return vectors.mapInArrow(run, kind)


def train(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT) -> np.ndarray:
    """The centroids after all rounds, from a stored table of ``integers``."""
    centroids = seeds(vectors, k, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = SALT) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each usable vector."""
    table = stored(integers(vectors, size, scale), "vectors")
    centroids = train(table, k, rounds, salt)
    if not len(centroids):
        table, centroids = table.limit(0), np.zeros((1, size), np.int64)
    placed = stored(assigned(table, centroids), "assigned")
    sums = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    own = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    return placed.select("vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(digest, F.col("cluster")).alias("centroid_sha256"))
