"""Constrained sets in rounds against one ordered pass."""

import random

import pytest
from pyspark.sql import functions as F

from lotewise.operators import resolve
from lotewise.sources.shared import dropped, stored


def one_pass(edges, source):
    parent, held = {}, {}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for *_, a, b in sorted(edges):
        for k in (a, b):
            parent.setdefault(k, k)
            held.setdefault(k, {source[k]})
        x, y = find(a), find(b)
        if x != y and not held[x] & held[y]:
            if len(held[x]) < len(held[y]):
                x, y = y, x
            parent[y] = x
            held[x] |= held[y]
    sets = {}
    for k in parent:
        sets.setdefault(find(k), set()).add(k)
    return sorted(map(sorted, sets.values()))


def sets_of(df):
    sets = {}
    for r in df.collect():
        sets.setdefault(r.raiz, set()).add(r.chave)
    return sorted(map(sorted, sets.values()))


def solve(spark, edges, source, batch):
    frame = spark.createDataFrame(edges, "stage int, r1 long, r2 long, r3 long, a string, b string") if isinstance(edges, list) else edges
    src = spark.createDataFrame(list(source.items()), "chave string, fonte string")
    return resolve.constrained_sets(frame, src, lambda df: stored(df, "rounds"), batch, dropped)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    n = 40
    source = {f"k{i}": f"f{rng.randrange(6)}" for i in range(n)}
    edges = [(rng.randrange(2), rng.randrange(9), rng.randrange(9), rng.randrange(9), f"k{a}", f"k{b}") for a, b in {tuple(rng.sample(range(n), 2)) for _ in range(150)}]
    assert sets_of(solve(spark, edges, source, [1000, 12, 3][seed % 3])) == one_pass(edges, source)


def test_no_edges(spark):
    assert solve(spark, [], {"k": "f"}, 5).count() == 0


def test_a_component_of_a_million_edges(spark):
    """5000 listings of 9 sources, each tied to 200 others in one component, in tasks of 250,000 edges."""
    n, many = 5000, 200
    mix = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 40))
    e = spark.range(n * many).select(F.lit(1).alias("stage"), mix("id").alias("r1"), F.col("id").alias("r2"), F.lit(0).cast("long").alias("r3"), F.concat(F.lit("k"), F.col("id") % n).alias("a"), F.concat(F.lit("k"), (F.col("id") % n + 1 + F.pmod(F.xxhash64("id", F.lit(7)), F.lit(n - 1))) % n).alias("b"))
    e = stored(e, "edges")
    source = {f"k{i}": f"f{i * i % 9}" for i in range(n)}
    got = sets_of(solve(spark, e, source, 250_000))
    assert got == one_pass([tuple(r) for r in e.collect()], source)
