"""Sources that fail or are stopped, counters that are observed, state kept by key, pages by position, exact quantiles."""

import datetime as dt
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from lotewise.operators import crawl, criteria, merge, quantiles
from lotewise.schema import LISTING, STATE
from lotewise.sources import config
from lotewise.sources.shared import stored
from lotewise.streaming import lifecycle

NOW, END = "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z"


def batch(spark, fonte, ids, **more):
    rows = spark.createDataFrame([(fonte, str(i), "casa", 500.0 + i, "Botucatu", "t", i) for i in ids], "fonte string, id string, tipo string, aluguel double, cidade string, titulo string, ord long")
    return merge.default_row(rows.withColumns(more), LISTING, ("ord",))


@pytest.fixture(scope="module")
def conf():
    return config.Config(cidade="Botucatu", uf="SP", fontes=[], aluguel_max=2000, tipos=["casa"], buscar_detalhes=False)


def test_a_source_that_fails_is_told_and_the_others_merge(spark, conf):
    state = merge.default_row(spark.createDataFrame([("c:1", "c", "1", True, 1)], "chave string, fonte string, id string, ativo boolean, ord long"), STATE)
    evaluated = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        evaluated.add(1)
        return x

    def broken():
        raise ValueError("no such page")

    scans = {
        "a": (batch(spark, "a", range(5), url=counted("titulo")), {"completo": True, "avisos": ["aviso"]}),
        "b": (batch(spark, "b", range(3), titulo=F.raise_error(F.lit("marking changed"))), {"completo": True}),
        "c": broken,
    }
    heard = []
    new, log, news = crawl.run(state, scans, conf, NOW, END, on_progress=heard.append)
    r = log.first()
    assert sorted(x.chave for x in new.where("ativo").collect()) == ["a:0", "a:1", "a:2", "a:3", "a:4", "c:1"]
    assert (r.fontes["a"].ok, r.fontes["a"].encontrados, r.fontes["a"].novos, r.fontes["a"].avisos, r.novos) == (True, 5, 5, ["aviso"], 5)
    assert not r.fontes["b"].ok and "marking changed" in r.fontes["b"].erro and r.fontes["b"].encontrados == 0
    assert r.fontes["c"].erro == "no such page" and r.fontes["c"].removidos == 0
    assert news.count() == 5 and evaluated.value == 5  # the scan was evaluated once, whatever was asked afterwards
    assert heard[-1]["b"]["fase"] == "erro" and any(h["a"].get("encontrados") == 5 for h in heard)


def test_a_stop_ends_the_running_stage(spark, conf):
    @F.udf("string")
    def slow(x):
        time.sleep(20)
        return x

    wanted, began = threading.Event(), time.monotonic()
    threading.Timer(4, wanted.set).start()
    scans = {f: (batch(spark, f, range(8), titulo=slow("titulo")), {}) for f in ("a", "b")}
    with pytest.raises(crawl.Cancelled):
        crawl.run(spark.createDataFrame([], STATE), scans, conf, NOW, END, stop=wanted.is_set)
    assert time.monotonic() - began < 18
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_pages_by_position(spark):
    rng = random.Random(3)
    rows = [(f"a:{i}", rng.choice([None, "2024-01-01", "2024-01-02"]), rng.choice([None, 5.0, 7.0, 9.0]), rng.choice([None, 10.0, 0.0]), i, True) for i in range(60)]
    state = merge.default_row(spark.createDataFrame(rows, "chave string, primeira_vez string, aluguel double, area double, ord long, ativo boolean"), STATE)
    for order in ("recentes", "preco", "m2", "area", "ia", "lista"):
        whole = [r.chave for r in criteria.listing(state, None, order).collect()]
        got, since = [], None
        while page := criteria.listing(state, None, order, 25, since=since).select("chave", criteria.position(order).alias("at")).collect():
            got += [r.chave for r in page]
            since = tuple(page[-1]["at"])
        assert got == whole and len(whole) == 60


def test_signatures(spark):
    texts = ["Apartamento no Jardim Paraíso", "casa com edícula e piscina " * 50, "", None, "ação", "ab", "x" * 30_000 + " lareira", "日本語のテキスト"]
    rows = stored(criteria.with_signature(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), F.col("t")), "signed")
    for query in ("paraiso", "EDÍCULA piscina", "lareira", "ab", "acao", "jardim piscina", "", "本語の", "nada disso"):
        plain = rows.drop("assinatura").where(criteria.matches_text(query, F.col("t"))) if query.strip() else rows
        assert sorted(r.id for r in criteria.search_text(rows, query, F.col("t")).collect()) == sorted(r.id for r in plain.collect()), query
    assert rows.where(criteria.may_match("lareira", F.col("assinatura"))).count() == 1
    assert max(len(r.assinatura) for r in rows.collect()) == criteria.MOST_BYTES


def test_quantiles(spark):
    rng = random.Random(5)
    rows = [("a", rng.choice([1.0, 2.5, 1e9, -3.0, rng.random()])) for _ in range(400)] + [("b", 7.0)] * 30 + [("c", 1.0), ("d", None), ("d", float("nan")), ("e", -1e300), ("e", 1e300), ("e", 5e-300)]
    at = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    for parts in (2, 4096):
        got = {(r.g, r.p): r.q for r in quantiles.exact_quantiles(df, ["g"], "v", at, lambda x: stored(x, "q"), parts).collect()} if parts > 2 else {(r.g, r.p): r.q for r in quantiles.exact_quantiles(df.where("g <> 'e'"), ["g"], "v", at, lambda x: stored(x, "q"), 64).collect()}
        for g in "abc" if parts == 2 else "abce":
            own = [v for x, v in rows if x == g]
            for p in at:
                assert got[g, p] == pytest.approx(quantiles.quantile(own, p), rel=1e-12)
        assert not any(g == "d" for g, _ in got)


SIGHTINGS = "chave string, fonte string, id string, ord long, visto string, em timestamp, aluguel double, condominio double, iptu double, total double"
DAYS = ["2024-01-01T10:00:00.000Z", "2024-01-02T10:00:00.000Z", "2024-01-03T10:00:00.000Z", "2024-01-04T10:00:00.000Z", "2024-01-05T10:00:00.000Z"]


def sightings(spark, day, rows):
    at = dt.datetime.fromisoformat(DAYS[day].replace("Z", "+00:00"))
    return spark.createDataFrame([(f"a:{i}", "a", str(i), n, DAYS[day], at, rent, condo, None, total) for n, (i, rent, condo, total) in enumerate(rows)], SIGHTINGS)


def test_keyed_state_equals_the_merge(spark, tmp_path):
    """Four micro-batches, with a restart after the second, against the merge of the same scans."""
    lifecycle.prepare(spark)
    scans = [[(1, 500.0, 50.0, None), (2, None, None, 700.0), (1, 1.0, None, None)], [(1, 500.0, None, 600.0), (3, 10.0, 1.0, 11.0)], [(1, 450.0, None, None), (2, 800.0, 5.0, None), (3, 10.0, None, None)], [(3, None, None, None), (1, 500.0, 60.0, None)]]
    src, seen = tmp_path / "in", []
    src.mkdir()
    state = spark.createDataFrame([], STATE)
    none = spark.createDataFrame([], "fonte string, completo boolean")

    def catch(df, _):
        seen.extend(df.collect())

    def go():
        stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        q = lifecycle.lifecycle_stream(stream).writeStream.foreachBatch(catch).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    for day, rows in enumerate(scans):
        df = sightings(spark, day, rows)
        df.coalesce(1).write.parquet(f"{src}/{day}")
        given = merge.default_row(df.select("fonte", "id", "aluguel", "condominio", "iptu", "total", "ord"), LISTING, ("ord",))
        state = stored(merge.apply_results(state, given, none, DAYS[day]).drop("acao"), "state")
        if day in (1, 3):  # two batches, then the rest from the checkpoint
            go()
    last = {r.chave: r for r in seen}
    history = lambda r: [tuple(h) for h in r.historico_precos]
    want = {r.chave: (r.primeira_vez, r.ultima_vez, r.ativo, r.inativo_desde, history(r)) for r in state.collect()}
    assert {k: (r.primeira_vez, r.ultima_vez, r.ativo, r.inativo_desde, history(r)) for k, r in last.items()} == want
    assert [r.acao for r in seen if r.chave == "a:2"] == ["inserir", "atualizar"]


def test_unseen_listings_become_inactive(spark, tmp_path):
    lifecycle.prepare(spark)
    src, seen = tmp_path / "in", []
    src.mkdir()
    for day, ids in enumerate([(1, 2), (2,), (2,), (2,), (2, 1)]):
        sightings(spark, day, [(i, 5.0, None, None) for i in ids]).coalesce(1).write.parquet(f"{src}/{day}")
    stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = lifecycle.lifecycle_stream(stream, dt.timedelta(hours=36)).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    one = [(r.acao, r.ativo, r.inativo_desde) for r in seen if r.chave == "a:1"]
    assert one == [("inserir", True, None), ("desativar", False, "2024-01-02T22:00:00.000Z"), ("atualizar", True, None)]
    assert [r.acao for r in seen if r.chave == "a:2"][:3] == ["inserir", "atualizar", "atualizar"]
