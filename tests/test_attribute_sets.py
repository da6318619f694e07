"""Groups by attributes without their edges, against one ordered pass over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from lotewise.operators import resolve
from lotewise.operators.merge import default_row
from lotewise.schema import STATE
from lotewise.sources.shared import dropped, stored

from .test_rounds import one_pass, sets_of

ROW = "chave string, fonte string, plataforma string, ord long, tipo string, bairro string, quartos int, area double, banheiros int, vagas int, condominio double, aluguel double, ativo boolean"
NONE = "id string, pos int, plataforma string, nome string, apelidos array<string>"


def store(df):
    return stored(df, "sets")


def listings(spark, rows):
    return store(default_row(spark.createDataFrame(rows, ROW), STATE))


def some(rng, n, sources):
    order = rng.sample(range(10 * n), n)
    of = lambda *values: rng.choice(values)
    return [(f"k{i}", f"f{rng.randrange(sources)}", "msys", order[i], of("casa", "apartamento"), "Centro", 2, of(20.0, 21.5, 23.5, 60.0, 62.4, 90.0), of(None, 1, 2), of(None, 1), of(None, 10.0, 14.0, 19.0), of(900.0, 800.0), True) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_sets_equal_one_pass(spark, seed):
    """Listings bound before by references too, replayed whole, or (small ``batch``) by their edges."""
    rng = random.Random(seed)
    rows = some(rng, 160, 4)
    state = listings(spark, rows)
    source = {r[0]: r[1] for r in rows}
    refs = [(0, i, 0, 0, *rng.sample(sorted(source), 2)) for i in range(25)]
    frame = spark.createDataFrame(refs, "stage int, r1 long, r2 long, r3 long, a string, b string")
    first = resolve.constrained_sets(frame, state.select("chave", "fonte"), store, drop=dropped)
    got = sets_of(resolve.attribute_sets(state, first, store, [resolve.BATCH, 5][seed % 2], dropped))
    edges = [tuple(r) for r in resolve.attribute_edges(state).collect()]
    want = one_pass(refs + edges, source)
    several = lambda sets: [s for s in sets if len(s) > 1]
    assert several(got) == several(want) and len(several(want)) > 20


def test_copies_are_not_paired(spark):
    """A thousand copies in seven sources: no table that is stored on the way has more rows than a few for each."""
    n = 1000
    state = listings(spark, [(f"k{i}", f"f{i % 7}", "msys", i, "casa", "Centro", 2, 50.0, 1, 1, None, 900.0, True) for i in range(n)])
    counts = []

    def counted(df):
        out = store(df)
        counts.append(out.count())
        return out

    groups = resolve.assign_groups(state, spark.createDataFrame([], NONE), counted, drop=dropped)
    sizes = groups.groupBy("grupo").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(r.n for r in sizes) == [6, *[7] * 142] and max(counts) <= 2 * n
