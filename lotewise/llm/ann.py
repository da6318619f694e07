"""Nearest neighbours by inner product: one hierarchical small-world graph per shard.

Rows are dealt to shards by a hash of the id: of ``SHARD_ROWS`` rows, or, where that makes more than four
shards a core, of up to ``MOST_ROWS``, as every query asks every shard. Each shard's graph is built
in one task: equal vectors become one node; levels are drawn geometrically; at each level a node's
links are picked from its near nodes (found in blocks by matrix products inside the shard) by the
diversity rule, nearest first, and made mutual up to a bound. A graph is one row of flat arrays
(vectors, ids, neighbour lists by level) in the shared folder. Queries go in blocks to every
shard's graph; a block is searched in lock-step, greedily down the levels, then with a beam at the
bottom, which also begins at the longest vectors. Shard results are merged by score.

For inner products the vectors get one more coordinate that makes all norms equal, so that the
largest product is the nearest vector; reported scores are inner products of the original vectors
in double precision. All rows are indexed; nothing is broadcast.

Defined cases: null, zero or non-finite vectors and rows with a null id take no part, nor do vectors of
another length than most have (of equally many, the longer); ties go to the smaller id; a repeated row
is a candidate of its own but for the query's id; equal query rows count once, unequal ones of one id
share its ranks; fewer candidates than ``k`` give them all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARD_ROWS, MOST_ROWS = 8192, 65_536
QUERY_BLOCK = 512
#: Links of a node above the bottom (twice as many there), beam of a search, results.
LINKS, BEAM, K = 16, 256, 20
#: Open nodes of a query that one step looks around, longest vectors that a search also begins at, and near nodes for each link of a list among which its links are picked.
OPEN, HEADS, NEAR = 8, 32, 2
#: Nodes looked around without a change of a query's nearest ``k`` after which it is done, though its beam has open ones.
PATIENCE = 72
SEED = 7


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _near(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k nearest other rows of each row, nearest first, and their squared distances, by blocks."""
    n = len(x)
    k = min(k, n - 1)
    sq = (x * x).sum(1)
    out, far = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    step = max(1, (1 << 24) // n)  # bounds a block of distances
    for i in range(0, n, step):
        d = sq[i : i + step, None] + sq[None, :] - 2 * (x[i : i + step] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < n - 1 else np.argsort(d, axis=1)[:, :k]
        own = np.take_along_axis(d, part, 1)
        by = np.argsort(own, axis=1, kind="stable")
        out[i : i + step], far[i : i + step] = np.take_along_axis(part, by, 1), np.take_along_axis(own, by, 1)
    return out, far


def _links(x: np.ndarray, most: int) -> np.ndarray:
    """Neighbour lists (n by 2*most, -1 for none) of the nodes x by the diversity rule, made mutual."""
    n = len(x)
    out = np.full((n, 2 * most), -1, np.int32)
    if n < 2:
        return out
    near, dist = _near(x, min(NEAR * most, n - 1))
    rows = np.arange(n)
    picked = np.full((n, most), -1, np.int32)
    count = np.zeros(n, np.int64)
    for c in range(near.shape[1]):  # candidate c of every node at once
        ok = count < most
        cand, d = near[:, c], dist[:, c]
        for s in range(most):
            has = ok & (s < count)
            if not has.any():
                break
            r = rows[has]
            closer = ((x[cand[r]] - x[picked[r, s]]) ** 2).sum(1) < d[r]
            ok[r[closer]] = False
        r = rows[ok]
        picked[r, count[r]] = cand[r]
        count[r] += 1
    for c in range(near.shape[1]):  # places left over take the nearest not yet picked
        r = rows[count < most]
        if not len(r):
            break
        new = ~(picked[r] == near[r, c][:, None]).any(1)
        picked[r[new], count[r[new]]] = near[r[new], c]
        count[r[new]] += 1
    out[:, :most] = picked
    a, b = np.repeat(rows, most), picked.reshape(-1)
    a, b = a[b >= 0], b[b >= 0]
    apart = np.concatenate([((x[a[i : i + 65536]] - x[b[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(a), 65536)])
    back = np.lexsort((apart, b))
    a, b = a[back], b[back]
    first = np.concatenate(([True], b[1:] != b[:-1]))
    place = np.arange(len(b)) - np.maximum.accumulate(np.where(first, np.arange(len(b)), 0))
    keep = place < most
    out[b[keep], most + place[keep]] = a[keep]
    return out


def build(ids: np.ndarray, vectors: np.ndarray, norm: float) -> dict[str, np.ndarray]:
    """The flat arrays of one shard's graph; ``norm`` is at least every vector's norm."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    unique, node = np.unique(vectors, axis=0, return_inverse=True)
    node = node.reshape(-1)
    by = np.argsort(node, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=len(unique)))))
    extra = np.sqrt(np.maximum(norm**2 - (unique.astype(float) ** 2).sum(1), 0)).astype(np.float32)
    x = np.concatenate([unique.astype(np.float32), extra[:, None]], 1)
    level = (-np.log(1 - np.random.default_rng(SEED).random(len(x))) / math.log(LINKS)).astype(int)
    top = int(level.max())
    level[int(level.argmax())] = top
    heads = np.argsort(extra, kind="stable")[:HEADS]  # least of the extra coordinate: the longest vectors
    g = {"ids": ids[by], "begin": begin, "x": x, "raw": unique.astype(np.float64), "top": np.array([top]), "entry": np.array([int(level.argmax())]), "heads": heads}
    for at in range(top + 1):
        own = np.flatnonzero(level >= at)
        lists = _links(x[own], LINKS if at else 2 * LINKS)
        g[f"nodes{at}"] = own
        g[f"links{at}"] = np.where(lists >= 0, own[lists], -1).astype(np.int32)
    return g


def search_graph(g: dict[str, np.ndarray], q: np.ndarray, beam: int, k: int = K + 1) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the nearest found for every query (rows of q with 0 appended), nearest first."""
    x, n, m = g["x"], len(g["x"]), len(q)
    q = np.concatenate([q.astype(np.float32), np.zeros((m, 1), np.float32)], 1)
    far = lambda rows, nodes: ((x[nodes] - q[rows]) ** 2).sum(-1)
    at = np.full(m, g["entry"][0])
    dist = far(np.arange(m), at)
    for lv in range(int(g["top"][0]), 0, -1):
        where = np.full(n, -1)
        where[g[f"nodes{lv}"]] = np.arange(len(g[f"nodes{lv}"]))
        moving = np.arange(m)
        while len(moving):
            around = g[f"links{lv}"][where[at[moving]]]
            d = np.where(around >= 0, ((x[around] - q[moving][:, None, :]) ** 2).sum(2), np.inf)
            best = d.argmin(1)
            closer = d[np.arange(len(moving)), best] < dist[moving]
            moving, best, around, d = moving[closer], best[closer], around[closer], d[closer]
            at[moving] = around[np.arange(len(moving)), best]
            dist[moving] = d[np.arange(len(moving)), best]
    beam = min(max(beam, len(g["heads"]) + 1), n)
    nodes, ds, done = np.full((m, beam), -1), np.full((m, beam), np.inf, np.float32), np.ones((m, beam), bool)
    start = np.concatenate([at[:, None], np.broadcast_to(g["heads"], (m, len(g["heads"])))], 1)
    start = np.where((start == at[:, None]) & (np.arange(start.shape[1]) > 0), -1, start)[:, :beam]
    first = np.where(start >= 0, ((x[start] - q[:, None, :]) ** 2).sum(2), np.inf)
    nodes[:, : start.shape[1]], ds[:, : start.shape[1]], done[:, : start.shape[1]] = start, first, start < 0
    seen, mark = np.zeros((m, n), bool), np.zeros((m, n), np.int32)
    seen[np.repeat(np.arange(m), start.shape[1])[start.reshape(-1) >= 0], start[start >= 0]] = True
    links = g["links0"]
    live = np.arange(m)
    worst, idle = np.full(m, np.inf, np.float32), np.zeros(m, np.int64)
    while len(live):
        open_d = np.where(done[live], np.inf, ds[live])
        pick = np.argpartition(open_d, min(OPEN, beam) - 1, axis=1)[:, :OPEN]
        has = np.isfinite(np.take_along_axis(open_d, pick, 1))
        some = has.any(1)
        live, pick, has = live[some], pick[some], has[some]
        if not len(live):
            break
        done[live[:, None], pick] |= has
        around = np.where(has[:, :, None], links[nodes[live[:, None], pick]], -1).reshape(len(live), -1)
        r, c = np.repeat(np.arange(len(live)), around.shape[1]), around.reshape(-1)
        at_ = np.flatnonzero((c >= 0) & ~seen[live[r], c])
        # a node named twice counts once: the last to leave its mark
        mark[live[r[at_]], c[at_]] = at_
        at_ = at_[mark[live[r[at_]], c[at_]] == at_]
        seen[live[r[at_]], c[at_]] = True
        new = np.full(around.shape, np.inf, np.float32)
        new.reshape(-1)[at_] = ((x[c[at_]] - q[live[r[at_]]]) ** 2).sum(1)
        all_d = np.concatenate([ds[live], new], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        ds[live] = np.take_along_axis(all_d, best, 1)
        nodes[live] = np.take_along_axis(np.concatenate([nodes[live], around], 1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~np.isfinite(new)], 1), best, 1)
        kth = np.partition(ds[live], min(k, beam) - 1, axis=1)[:, min(k, beam) - 1]
        idle[live] = np.where((kth < worst[live]) | ~np.isfinite(kth), 0, idle[live] + has.sum(1))
        worst[live] = kth
        live = live[idle[live] < PATIENCE]
    by = np.argsort(ds, 1, kind="stable")
    return np.where(np.isfinite(np.take_along_axis(ds, by, 1)), np.take_along_axis(nodes, by, 1), -1), np.take_along_axis(ds, by, 1)


def _flat(shard: int, g: dict[str, np.ndarray]) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "names": pa.array([list(g)], pa.list_(pa.string())), "kinds": pa.array([[a.dtype.str for a in g.values()]], pa.list_(pa.string())), "widths": pa.array([[a.shape[1] if a.ndim > 1 else 0 for a in g.values()]], pa.list_(pa.int64())), "data": pa.array([[np.ascontiguousarray(a).tobytes() for a in g.values()]], pa.list_(pa.binary()))})


_GRAPH = "shard int, names array<string>, kinds array<string>, widths array<bigint>, data array<binary>"


def _graph(names: list, kinds: list, widths: list, data: list) -> dict[str, np.ndarray]:
    return {n: (a := np.frombuffer(d, k)).reshape(-1, w) if w else np.frombuffer(d, k) for n, k, w, d in zip(names, kinds, widths, data, strict=True)}


def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(flat)
    values = np.asarray(flat.flatten())
    return values.reshape(n, -1) if n else np.zeros((0, 0))


def _rows(vectors: DataFrame) -> tuple[DataFrame, float, int]:
    """(rows that take part, largest norm, their number)."""
    rows = vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    kinds = rows.groupBy(F.size("embedding").alias("dim")).agg(F.max(square).alias("q"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not kinds:
        return rows, 1.0, 0
    return rows.where(F.size("embedding") == kinds[0]["dim"]), math.sqrt(kinds[0]["q"]), kinds[0]["n"]


def _shards(spark, n: int, shard_rows: int | None) -> int:
    """Number of shards for ``n`` rows."""
    rows = shard_rows or min(MOST_ROWS, max(SHARD_ROWS, math.ceil(n / (4 * spark.sparkContext.defaultParallelism))))
    return max(1, math.ceil(n / rows))


def index(vectors: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """One row a shard with its graph, stored in the shared folder."""
    rows, norm, n = _rows(vectors)
    return _index(rows, norm, _shards(vectors.sparkSession, n, shard_rows))


def _index(rows: DataFrame, norm: float, shards: int) -> DataFrame:
    def make(key: tuple, t: pa.Table) -> pa.Table:
        return _flat(key[0].as_py(), build(np.asarray(t.column("vec_id")), _matrix(t.column("embedding")), norm))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return stored(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(make, _GRAPH), "hnsw")


def search(vectors: DataFrame, is_query: Column, k: int = K, beam: int = BEAM, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that ``is_query`` picks."""
    rows, norm, total = _rows(vectors)
    shards = _shards(vectors.sparkSession, total, shard_rows)
    graphs = _index(rows, norm, shards)
    asked = rows.where(is_query).distinct()

    def block(key: tuple, t: pa.Table) -> pa.Table:
        q = _matrix(t.column("embedding")).astype(np.float64)
        ids = np.asarray(t.column("vec_id")).astype(np.int64)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([q.tobytes()], pa.binary())})

    n = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n)).cast("int")).groupBy("block").applyInArrow(block, "block int, ids binary, queries binary")
    # as many tasks as shards, which Spark may not merge: a task's work is its graph's, not its bytes'
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(shards, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                g = _graph(*[b.column(c)[i].as_py() for c in ("names", "kinds", "widths", "data")])
                own = np.frombuffer(b.column("ids")[i].as_py(), np.int64)
                q = np.frombuffer(b.column("queries")[i].as_py(), np.float64).reshape(len(own), -1)
                nodes, _ = search_graph(g, q, max(beam, k + 1), k + 1)
                out: list[tuple[int, int, float]] = []
                for r, (me, found) in enumerate(zip(own.tolist(), nodes, strict=True)):
                    found = found[found >= 0]
                    exact = (g["raw"][found] * q[r]).sum(1)
                    got = []
                    for c in np.argsort(-exact, kind="stable").tolist():
                        if len(got) >= k and exact[c] < got[k - 1][0]:
                            break
                        members = g["ids"][g["begin"][found[c]] : g["begin"][found[c] + 1]]  # ascending ids
                        got += [(float(exact[c]), v) for v in members[: k + 1].tolist() if v != me]
                        got.sort(key=lambda x: (-x[0], x[1]))
                    out += [(me, v, s) for s, v in got[:k]]
                if out:
                    a, v, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = sent.join(graphs.repartition(shards, "shard"), "shard").select("ids", "queries", "names", "kinds", "widths", "data").mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
