"""The console's commands, one call each."""

import pytest

from lotewise.operators import crawl, merge
from lotewise.operators.console import Console
from lotewise.schema import LISTING, NEWS, RUN, STATE
from lotewise.sources import config
from lotewise.sources.state import StateStore

NOW = "2024-01-03T00:00:00Z"


@pytest.fixture
def console(spark, tmp_path):
    rows = [("a:1", "a", "novo", "g:a:1", 900.0, "2024-01-01", 0, True), ("b:2", "b", "novo", "g:a:1", 800.0, "2024-01-02", 1, True), ("b:3", "b", "visita", None, None, "2024-01-02", 2, True), ("b:4", "b", "novo", None, 500.0, "2024-01-01", 3, False)]
    state = merge.default_row(spark.createDataFrame(rows, "chave string, fonte string, status string, grupo string, aluguel double, primeira_vez string, ord long, ativo boolean").selectExpr("*", "split(chave, ':')[1] AS id", "'casa' AS tipo", "2 AS quartos", "'t' AS titulo", "'' AS notas"), STATE)
    store = StateStore(spark, f"file://{tmp_path}/state")
    store.write(state)
    runs = spark.createDataFrame([("r1", "2024-01-02", "x", {}, 1)], RUN)
    found = merge.default_row(spark.createDataFrame([("c", "9", "casa", 700.0, "Botucatu", "t", 0)], "fonte string, id string, tipo string, aluguel double, cidade string, titulo string, ord long"), LISTING, ("ord",))
    conf = config.Config(cidade="Botucatu", uf="SP", fontes=[], tipos=["casa"], buscar_detalhes=False)

    def search(fontes, details, again):
        scans = {"c": (found, {"completo": True}), "d": (found.limit(0), {"erro": "bloqueado"})}
        return crawl.run(store.read(), {f: s for f, s in scans.items() if not fontes or f in fontes}, conf, NOW, NOW)

    return Console(store, runs, spark.createDataFrame([("2024-01-02", 0, "b:3")], NEWS), lambda: NOW, ("c", "d"), search)


def test_reading(console):
    keys = lambda *args: [r.chave for r in console.call(["listar", *args]).rows.collect()]
    assert keys() == ["b:2", "b:3"] and keys("--todos") == ["b:2", "b:3", "b:4"] and keys("--status", "visita") == ["b:3"] and keys("--novos") == ["b:3"] and keys("--limite", "1") == ["b:2"]
    first = console.call(["listar", "--limite", "1"]).rows.first()
    assert first.de == 2 and first.tambem_em == ["a"]
    assert console.call(["listar", "--format", "table"]).rows.count() >= 2
    r = console.call(["resumo"]).rows.first()
    assert (r.total, r.ativos, r.por_fonte, r.ultima_busca.novos) == (4, 3, {"a": 1, "b": 2}, 1)
    assert [tuple(x)[:3] for x in console.call(["estatisticas"]).rows.collect()] == [("casa · 2 quartos", 1, 900.0)]
    r = console.call(["ver", "a:1"]).rows.first()
    assert r.aluguel == 900.0 and [x.asDict() for x in r.tambem_em] == [{"chave": "b:2", "url": None, "aluguel": 800.0, "anunciante": None}]


def test_changes(console):
    assert console.call(["status", "a:1", "contatado"]).rows.first().status == "contatado"
    assert console.call(["nota", "a:1", "liguei", "hoje"]).rows.first().notas.endswith("liguei hoje")
    r = console.call(["anotar", "a:1", "--nota", "80", "--resumo", "bom", "--alerta", "x", "--alerta", "y"]).rows.first()
    assert (r.ia.nota, r.ia.resumo, r.ia.alertas) == (80, "bom", ["x", "y"])


@pytest.mark.parametrize("line, kind", [("", "BAD_CMD"), ("voar", "BAD_CMD"), ("ver", "BAD_ARG"), ("ver a:99", "NOT_FOUND"), ("listar --status zzz", "BAD_ARG"), ("listar --limite 0", "BAD_ARG"), ("listar --oops", "BAD_ARG"), ("status a:1", "BAD_ARG"), ("status a:1 zzz", "BAD_ARG"), ("anotar a:1", "BAD_ARG"), ("anotar a:1 --nota x --resumo y", "BAD_ARG"), ("buscar --fonte c,zz", "BAD_ARG")])
def test_errors(console, line, kind):
    answer = console.call(line.split())
    assert (answer.code, answer.kind, answer.rows) == (1, kind, None) and answer.error


def test_crawl(console):
    answer = console.call(["buscar"])
    assert answer.code == 0 and {r.fonte: (r.ok, r.novos, r.erro) for r in answer.rows.collect()} == {"c": (True, 1, None), "d": (False, 0, "bloqueado")}
    assert console.call(["buscar", "--fonte", "d"]).code == 1
    assert [r.chave for r in console.call(["listar", "--todos", "--limite", "1"]).rows.collect()] == ["c:9"] and console.runs.count() == 3
