"""Requests against a server of our own, and the routes of the API."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lotewise.operators import merge
from lotewise.operators.api import Api
from lotewise.schema import RUN, STATE
from lotewise.sources import config, fetch
from lotewise.sources.state import StateStore


@pytest.fixture(scope="module")
def site():
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            size = int(self.headers.get("Content-Length") or 0)
            sent = self.rfile.read(size)
            what = {"/ok": (200, "<p>Olá".encode("cp1252"), "text/html; charset=ISO-8859-1"), "/gone": (410, b"", "text/html"), "/block": (503, b"<title>Just a moment...</title>", "text/html"), "/bad": (400, b"no", "text/html"), "/flaky": (200 if n > 2 else 500, b"<p>at last", "text/html"), "/busy": (429, b"slow", "text/html"), "/json": (200, b'{"a":1}', "application/json"), "/echo": (200, sent or b"{}", "application/json"), "/text": (200, b"oops", "text/plain")}.get(self.path, (404, b"", "text/html"))
            self.send_response(what[0])
            self.send_header("Content-Type", what[2])
            self.end_headers()
            self.wfile.write(what[1])

        do_GET = do_POST = answer

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_fetcher(site):
    at, seen = site
    naps = []
    f = fetch.Fetcher(gap=0.0, sleep=naps.append)
    assert f.html(f"{at}/ok") == "<p>Olá" and f.html(f"{at}/gone") is None and f.html(f"{at}/none") is None and f.json(f"{at}/none") is None
    assert f.json(f"{at}/json") == {"a": 1} and f.json(f"{at}/echo", {"b": [2]}) == {"b": [2]}
    assert f.html(f"{at}/flaky") == "<p>at last" and seen["/flaky"] == 3
    naps.clear()
    with pytest.raises(fetch.HttpError) as e:
        f.html(f"{at}/busy")
    assert e.value.status == 429 and seen["/busy"] == 5 and [int(x / 0.6 + 0.01) >= k for x, k in zip(naps, (1, 2, 4, 8), strict=True)] == [True] * 4 and max(naps) < 5.3
    with pytest.raises(fetch.Blocked):
        fetch.Fetcher(gap=0.0, retries=0).html(f"{at}/block")
    with pytest.raises(fetch.HttpError):
        f.html(f"{at}/bad")
    assert seen["/bad"] == 1
    with pytest.raises(ValueError):
        f.json(f"{at}/text")
    with pytest.raises(ConnectionError):
        fetch.Fetcher(gap=0.0, retries=1, sleep=naps.append).html("http://127.0.0.1:9/x")
    g = fetch.Fetcher(gap=0.05)
    began = time.monotonic()
    for _ in range(4):
        g.html(f"{at}/ok")
    assert time.monotonic() - began >= 0.15
    assert fetch.each([3, 1, 2], 2, lambda x: x * 2) == [6, 2, 4] and fetch.each([], 2, str) == []


def test_capture(spark, site):
    at, _ = site
    urls = spark.createDataFrame([(f"{at}/ok", 1), (f"{at}/gone", 2), (f"{at}/block", 3), (f"{at}/bad", 4), ("http://127.0.0.1:9/x", 5)], "url string, page int")
    got = {r.page: (r.status, r.html, r.erro) for r in fetch.capture(urls, gap=0.0, pause=0.01, retries=0).collect()}
    assert got[1] == (200, "<p>Olá", None) and got[2] == (404, None, None) and got[3] == (503, None, "bloqueado") and got[4][0] == 400 and got[5][0] == 0 and got[5][2]


def test_api(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s")
    names = "chave string, fonte string, id string, status string, notas string, ativo boolean, ord bigint, aluguel double"
    store.write(merge.default_row(spark.createDataFrame([("f:1", "f", "1", "novo", "", True, 0, 500.0)], names), STATE))
    src = spark.createDataFrame([("f", 0, "Casa", "msys", "u", True, None)], "id string, pos int, nome string, plataforma string, url string, ativo boolean, aviso string")
    detail = lambda row: row.select("fonte", "id", F.lit("longa").alias("descricao"))
    ran, go = [], threading.Event()

    def search(wanted):
        go.wait(10)
        ran.append(wanted)

    api = Api(store, spark.createDataFrame([], RUN), config.Config(cidade="B", uf="SP", fontes=[]), src, lambda: "2024-01-01", detail, search=search)
    status, text = api.answer("GET", "/api/dados")
    assert status == 200 and json.loads(text)["imoveis"][0]["chave"] == "f:1" and json.loads(text)["config"]["fontes"][0]["nome"] == "Casa"
    status, text = api.answer("PATCH", "/api/imoveis/f%3A1", '{"status":"visita","notas":"n"}')
    assert status == 200 and (json.loads(text)["status"], json.loads(text)["notas"], json.loads(text)["status_em"]) == ("visita", "n", "2024-01-01")
    status, text = api.answer("POST", "/api/imoveis/f:1/detalhe")
    assert status == 200 and json.loads(text)["descricao"] == "longa" and json.loads(text)["notas"] == "n"
    assert [api.answer(*x)[0] for x in (("PATCH", "/api/imoveis/f:9", "{}"), ("PATCH", "/api/imoveis/f%209", "{}"), ("PATCH", "/api/imoveis/f:1", "{"), ("PATCH", "/api/imoveis/f:1", '{"status":"x"}'), ("GET", "/x"), ("POST", "/api/imoveis/f:9/detalhe"))] == [404, 400, 400, 400, 404, 404]
    assert api.answer("POST", "/api/buscar", '{"fontes":["f",1]}')[0] == 202 and api.answer("POST", "/api/buscar")[0] == 409
    go.set()
    for _ in range(100):
        if not json.loads(api.answer("GET", "/api/buscar")[1])["rodando"]:
            break
        time.sleep(0.05)
    assert ran == [["f"]]
