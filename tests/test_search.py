"""What sources are asked, and captured answers read as a data source."""

import contextlib
import io
import json

import pytest

from lotewise.sources import captured, scan

ASK = captured.Ask("São Manuel", "SP", 2000.0, ("casa", "flat"), 3)
SITES = [
    {"id": "rb", "nome": "RB", "plataforma": "msys", "url": "https://rb.example/", "cidades": {"sao-manuel": 7}, "opcoes": {"hidePendingLocation": 1}},
    {"id": "ks", "nome": "KS", "plataforma": "ksi", "url": "https://ks.example"},
    {"id": "ke", "nome": "KE", "plataforma": "kenlo", "url": "https://ke.example"},
    {"id": "ag", "nome": "AG", "plataforma": "chavesnamao", "url": "https://ag.example"},
]


def test_addresses():
    ask = lambda n, **kw: [r.url for r in captured.requests(SITES[n], captured.Ask(**(vars(ASK) | kw)))]
    assert ask(1) == ["https://ks.example/alugar/Sao-Manuel?vma=2000", "https://ks.example/alugar/Sao-Manuel?vma=2000&pag=2", "https://ks.example/alugar/Sao-Manuel?vma=2000&pag=3"]
    assert ask(1, aluguel_max=None)[:2] == ["https://ks.example/alugar/Sao-Manuel", "https://ks.example/alugar/Sao-Manuel?pag=2"]
    assert ask(2, aluguel_max=1850.5)[:2] == ["https://ke.example/imoveis/para-alugar/sao-manuel?preco-de-locacao=0~1850.5", "https://ke.example/imoveis/para-alugar/sao-manuel?preco-de-locacao=0~1850.5&pagina=2"]
    assert ask(3, max_paginas=9)[:6] == [f"https://ag.example/apartamentos-para-alugar/sp-sao-manuel/{q}" for q in ("", "?pg=2", "?pg=3", "?pg=4", "?pg=5")] + ["https://ag.example/casas-para-alugar/sp-sao-manuel/"]
    assert len(ask(3, tipos=())) == 15 and len(ask(2, limite=13)) == 2 and len(ask(1, limite=1)) == 3
    with pytest.raises(ValueError, match="unknown platform"):
        captured.requests({"id": "x", "plataforma": "y", "url": "u"}, ASK)


def test_body():
    one, two, _ = captured.requests(SITES[0], ASK)
    body = json.loads(two.corpo)
    assert two.url == "https://rb.example/api/service/consult" and json.loads(one.corpo)["start"] == 0
    assert {k: body[k] for k in ("type", "idtCityList", "toPrice", "start", "numRows", "getAccess", "post", "sortList", "jsonPhotosNum", "hidePendingLocation", "hidePrevisionOutput")} == {"type": "L", "idtCityList": [7], "toPrice": 2000.0, "start": 50, "numRows": 50, "getAccess": True, "post": True, "sortList": ["dtaUpdate desc"], "jsonPhotosNum": 40, "hidePendingLocation": True, "hidePrevisionOutput": False}
    assert body["fieldList"][:2] == ["idtProperty", "jsonPhotos"] and body["fieldList"][-1] == "prop_char_621"
    assert json.loads(captured.requests(SITES[0], captured.Ask("São Manuel", ordem="valLocation asc"))[0].corpo)["sortList"] == ["valLocation asc"]
    assert captured.requests(SITES[0], captured.Ask("Bauru")) == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Captures of every page that the search asks for, and of a search with another ceiling."""
    html = {
        "rb": lambda n: json.dumps({"response": {"numFound": 120, "docs": [{"idtProperty": 100 * n + i, "valLocation": 900 + i} for i in range(50 if n < 3 else 20)]}}),
        "ks": lambda n: "".join(f'<div class="card card-imo"><a href="/alugar/Sao-Manuel/Casa/VILA/{n}{i}"></a></div>' for i in range(2 if n < 3 else 0)),
        "ke": lambda n: "<html>" if n == 2 else '<script>(function(){\n window.markoVars[\'listings-a\'] = {"settings":{"listings":{"count":30,"data":[' + ",".join(f'{{"property_full_reference":"K{n}-{i}"}}' for i in range(12)) + "]}}};\n})();</script>",
        "ag": lambda n: '<script type="application/ld+json">{"@type":"RealEstateListing","offers":{"numberOfItems":16,"itemListElement":[' + ",".join(f'{{"url":"https://x/imovel/casa-para-alugar-sp-sao-manuel-c/id-{n}{i}/","price":{1000 + 900 * i}}}' for i in range(3)) + "]}}</script>",
    }
    rows = [(r.fonte, r.page, r.caminho, r.url, r.corpo, 200, html[r.fonte](r.page)) for s in SITES for r in captured.requests(s, captured.Ask("São Manuel", "SP", 2000.0, (), 3))]
    rows += [(r.fonte, r.page, r.caminho, r.url, r.corpo, 500, "") for s in SITES for r in captured.requests(s, captured.Ask("São Manuel", "SP", 999.0, (), 3))[:1] if s["id"] != "ag"]
    path = f"file://{tmp_path_factory.mktemp('captures')}/pages"
    captured.write_captures(spark.createDataFrame(rows, "fonte string, page int, caminho string, url string, corpo string, status int, html string"), path)
    return path


def pages(spark, folder, **kw):
    return captured.search(spark, folder, SITES, "São Manuel", **({"uf": "SP", "aluguel_max": 2000, "max_paginas": 3} | kw))


def test_pushed(spark, folder):
    df = pages(spark, folder, tipos=["casa", "flat"])
    with contextlib.redirect_stdout(io.StringIO()) as said:
        df.explain("formatted")
    plan = said.getvalue()
    assert "EqualTo(cidade" in plan and "EqualTo(aluguel_max" in plan and "In(tipo" in plan and "Filter (" not in plan
    got = df.select("fonte", "caminho", "page", "tipo", "cidade", "aluguel_max", "status").collect()
    assert sorted((r.fonte, r.page) for r in got if r.fonte != "ag") == [(f, n) for f in ("ke", "ks", "rb") for n in (1, 2, 3)]
    assert {(r.caminho, r.tipo) for r in got if r.fonte == "ag"} == {("apartamentos-para-alugar", "flat"), ("casas-para-alugar", "casa")}
    assert {(r.cidade, r.aluguel_max, r.status) for r in got} == {("São Manuel", 2000.0, 200)}
    assert df.rdd.getNumPartitions() == 15  # a page of a source each
    assert {(r.fonte, r.status) for r in pages(spark, folder, aluguel_max=999).collect()} == {("rb", 500), ("ks", 500), ("ke", 500), ("ag", 200)}  # the aggregator is asked for no ceiling
    assert df.where("page = 2 AND fonte = 'ks'").count() == 1  # what is not pushed is left to Spark
    with pytest.raises(Exception, match="needs a city"):
        spark.read.format(captured.NAME).options(path=folder, fontes=json.dumps(SITES)).load().count()


def test_search(spark, folder):
    p = pages(spark, folder, tipos=["casa", "flat"])
    rows, told = scan.search(p, "msys")
    assert rows.count() == 120 and [tuple(r) for r in told.select("fonte", "paginas", "encontrados", "total", "completo", "erro").collect()] == [("rb", 3, 120, 120, True, None)]
    rows, _ = scan.search(pages(spark, folder, limite=60), "msys", limit=60)
    assert [r.id for r in rows.orderBy("page", "pos").collect()] == [str(100 * n + i) for n in (1, 2) for i in range(50)][:60]
    assert pages(spark, folder, limite=60).where("fonte = 'rb'").count() == 2
    rows, told = scan.search(p, "ksi")
    assert rows.count() == 4 and told.first().completo
    rows, told = scan.search(p, "kenlo")  # its second page has lost its state
    assert rows.count() == 12 and (told.first().completo, told.first().erro) == (False, "erro")
    rows, told = scan.search(p, "chavesnamao", city_slug="sp-sao-manuel", max_rent=2000.0, types=["casa", "flat"])
    assert sorted(r.id for r in rows.collect()) == ["10", "11", "20", "21"] and (told.first().total, told.first().completo) == (32, True)
    assert scan.first_rows(rows, 0, "page").count() == 4
