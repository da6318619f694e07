"""Clustering against a brute force in Python's integers, with the defined cases."""

import hashlib
import math

import numpy as np
import pytest

from lotewise.llm import clustering, common

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, short int, cluster string, distance double"


def brute(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    place = lambda: [min((far(v, w), j) for j, w in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = place()
        for j in range(len(c)):
            own = [v for (_, v), (_, a) in zip(kept, at, strict=True) if a == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = place()
    sums = [sum(d for d, a in at if a == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((-1 if i is None else i), a, d, sums[a], sum(sums), sha[a]) for (i, _), (d, a) in zip(kept, at, strict=True))


def rows_of(df):
    return sorted(((-1 if r.vec_id is None else r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    homes = rng.normal(0, 1, (5, 64))
    rows = [(i, (homes[i % 5] + rng.normal(0, 0.3, 64)).astype(np.float32).tolist()) for i in range(160)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # a group of copies
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[9][1]), (300, [0.0] * 64), (301, [-0.0] * 64)]
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [None] + [1.0] * 63), (404, [math.nan] * 64), (405, [math.inf] + [0.0] * 63)]
    return rows


def frame(spark, rows):
    common.prepare(spark)
    return spark.createDataFrame([(i, v, 0, 1, 2, "c", 0.5) for i, v in rows], SCHEMA).repartition(3)


def test_clusters(spark, vectors):
    got = clustering.clusters(frame(spark, vectors))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert rows_of(got) == brute(vectors)


def test_few_and_none(spark, vectors):
    assert rows_of(clustering.clusters(frame(spark, vectors[:3] + vectors[:1]))) == brute(vectors[:3] + vectors[:1])
    odd = frame(spark, vectors)
    assert clustering.clusters(odd.where("vec_id >= 400")).count() == 0 and clustering.clusters(odd.limit(0)).count() == 0
    assert clustering.clusters(odd.where("vec_id is null")).count() == 0


def test_empty_clusters_stay(spark):
    rows = [(i, [0.5] * 64) for i in range(12)]  # all seeds equal: only the first has vectors
    assert rows_of(clustering.clusters(frame(spark, rows))) == brute(rows)


def test_screening_is_exact_and_spares_work():
    rng = np.random.default_rng(2)
    homes = rng.integers(-2000, 2000, (8, 61))
    homes[:, :8] *= np.arange(1, 9)[:, None]  # segments of unlike norms
    x = homes[rng.integers(0, 8, 4000)] + rng.integers(-40, 40, (4000, 61))
    at, far, exact = clustering.nearest(x, clustering.norms(x), homes)
    all_ = ((x[:, None] - homes[None]) ** 2).sum(2)
    assert (at == all_.argmin(1)).all() and (far == all_.min(1)).all() and len(x) <= exact < 3 * len(x)
    y = rng.integers(-(1 << 26), 1 << 26, (500, 61))
    at, far, _ = clustering.nearest(y, clustering.norms(y), y[:8])
    all_ = ((y[:, None] - y[None, :8]) ** 2).sum(2)
    assert (at == all_.argmin(1)).all() and (far == all_.min(1)).all()


def test_too_large(spark):
    with pytest.raises(Exception, match="would leave 64 bits"):
        clustering.clusters(frame(spark, [(1, [1e6] * 64)]))
