"""Composed transitions against a step at a time."""

import random

from lotewise.operators import transitions
from lotewise.operators.merge import default_row
from lotewise.schema import STATE, STATUSES


def walk(status, events):
    before = None
    for kind, to in events:
        if kind == "desfazer":
            if before is not None:
                status, before = before, None
        elif kind == "contatar":
            if status in ("novo", "interesse"):
                status, before = "contatado", status
        elif kind in ("favoritar", "descartar"):
            on = {"favoritar": "interesse", "descartar": "descartado"}[kind]
            status, before = ("novo" if status == on else on), status
        elif kind == "marcar" and to in STATUSES:
            status, before = to, status
    return status


def test_histories(spark, monkeypatch):
    monkeypatch.setattr(transitions, "_RUN_BITS", 2)  # runs of four events, blocks of four runs
    monkeypatch.setattr(transitions, "_BLOCK_BITS", 4)
    rng = random.Random(1)
    kinds = ["contatar", "favoritar", "descartar", "desfazer", "marcar", "outra coisa", None]
    events = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i // 4, i, rng.choice(kinds), rng.choice([*STATUSES, "nada", None])) for i in range(900)]
    rows = spark.createDataFrame(random.Random(2).sample(events, len(events)) + [(None, 1, 1, "favoritar", None)], "chave string, t int, n int, evento string, para string").repartition(5)
    h = transitions.histories(rows, "chave", "evento", "para", ["t", "n"])
    for start in (None, *STATUSES):
        got = {r.chave: (r.s, r.n) for r in h.select("chave", transitions.status_after(transitions.F.lit(start).cast("string"), transitions.F.col("map")).alias("s"), "n").collect()}
        own = {k: [(e, p) for c, _, _, e, p in events if c == k] for k in {e[0] for e in events}}
        assert got == {k: (walk(start or "novo", v), len(v)) for k, v in own.items()}


def test_apply_events(spark):
    state = default_row(spark.createDataFrame([("a:1", "novo"), ("a:2", "visita"), ("a:3", "proposta")], "chave string, status string"), STATE)
    events = spark.createDataFrame([("a:1", "2026-01-01", "contatar", None), ("a:1", "2026-01-02", "marcar", "visita"), ("a:2", "2026-01-01", "descartar", None), ("a:2", "2026-01-03", "desfazer", None), ("zz", "2026-01-01", "descartar", None)], "chave string, em string, evento string, para string")
    got = {r.chave: (r.status, r.status_em) for r in transitions.apply_events(state, events, ["em"]).collect()}
    assert got == {"a:1": ("visita", "2026-01-02"), "a:2": ("visita", "2026-01-03"), "a:3": ("proposta", None)}
    assert transitions.apply_events(state, events.limit(0), ["em"]).columns == state.columns
