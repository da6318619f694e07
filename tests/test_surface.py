"""Stores, commands, runs and groups: what the registered queries cannot show."""

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotewise.operators import commands, crawl, criteria, merge, resolve, views
from lotewise.schema import RUN, STATE
from lotewise.sources import config, details, platforms, scan, state


def rows_of(spark, rows, schema=STATE):
    names = sorted({k for r in rows for k in r})
    kinds = {"ord": "bigint", "area": "double", "aluguel": "double", "quartos": "int", "banheiros": "int", "vagas": "int", "condominio": "double", "ativo": "boolean", "detalhado": "boolean"}
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))
    return merge.default_row(df, schema)


def test_store_commits_are_exclusive(spark, tmp_path):
    s = state.StateStore(spark, f"file://{tmp_path}/s")
    assert s.read().count() == 0 and s.versions() == []
    one = rows_of(spark, [{"chave": "f:1", "id": "1", "fonte": "f"}])
    assert s.write(one) == 1
    base = s.versions()[-1]
    assert s.write(one.unionByName(rows_of(spark, [{"chave": "f:2"}])), base) == 2
    with pytest.raises(state.Conflict):
        s.write(one, base)
    assert s.read().count() == 2 and s.read(1).count() == 1
    for _ in range(3):
        s.update(lambda x: x.limit(1))
    assert s.versions() == [3, 4, 5] and s.read().count() == 1
    assert len(list((tmp_path / "s" / "data").glob("*/_SUCCESS"))) == 3


def test_lock_is_its_owners(spark, tmp_path, monkeypatch):
    s = state.StateStore(spark, f"file://{tmp_path}/s")
    (tmp_path / "s").mkdir()
    monkeypatch.setattr(state, "LOCK_TIMEOUT", 0.3)
    with s.lock() as token:
        assert (tmp_path / "s" / ".lock").read_text() == token
        with pytest.raises(TimeoutError), s.lock():
            pass
        s._fs.delete(s._path(f"{s.path}/.lock"), False)
        s._create(f"{s.path}/.lock", "someone else's")
    assert (tmp_path / "s" / ".lock").read_text() == "someone else's"
    monkeypatch.setattr(state, "LOCK_STALE", -1.0)
    with s.lock():
        pass
    assert not (tmp_path / "s" / ".lock").exists()
    monkeypatch.setattr(state, "LOCK_STALE", 120.0)
    monkeypatch.setattr(state, "LOCK_TIMEOUT", 30.0)
    held = []

    def hold():
        with s.lock():
            held.append(1)

    t = threading.Thread(target=hold)
    with s.lock():
        t.start()
        assert not held
    t.join(20)
    assert held == [1]


def test_import_and_export(spark, tmp_path):
    assert [df.count() for df in state.import_json(spark, f"file://{tmp_path}/none.json")] == [0, 0, 0]
    doc = {"versao": 1, "imoveis": {"b:1": {"chave": "b:1", "aluguel": 900, "fotos": ["x"], "historico_precos": [{"data": "2024-01-01", "aluguel": 900, "total": None}], "notas": "n"}, "a:2": {"aluguel": None}}, "execucoes": [{"id": "t", "inicio": "t", "fontes": {"b": {"ok": True, "encontrados": 1}}, "novos": ["b:1"]}]}
    (tmp_path / "s.json").write_text(json.dumps(doc))
    rows, runs, news = state.import_json(spark, f"file://{tmp_path}/s.json")
    assert [(r.chave, r.ord, r.aluguel) for r in rows.orderBy("ord").collect()] == [("b:1", 0, 900.0), ("a:2", 1, None)]
    assert [tuple(r) for r in news.collect()] == [("t", 0, "b:1")] and runs.first().novos == 1
    assert runs.first().fontes["b"].encontrados == 1 and runs.columns == [c.split(" ")[0] for c in RUN.replace("map<string,struct<", "").split(", ") if " " in c][:1] + runs.columns[1:]
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception, match="(?i)malformed|json"):
        state.import_json(spark, f"file://{tmp_path}/bad.json")[0].collect()
    (tmp_path / "other.json").write_text('{"x": 1}')
    assert state.import_json(spark, f"file://{tmp_path}/other.json")[0].count() == 0
    c = config.Config(cidade="B", uf="SP", fontes=[])
    src = spark.createDataFrame([("b", 0, "Casa B", "msys", "u", True, None)], "id string, pos int, nome string, plataforma string, url string, ativo boolean, aviso string")
    parts = views.payload(rows, runs, c, src, private=False)
    state.export_payload(parts, f"file://{tmp_path}/site")
    state.export_payload(parts, f"file://{tmp_path}/site")
    lines = [json.loads(x) for p in (tmp_path / "site" / "imoveis").glob("*.json") for x in p.read_text().splitlines()]
    assert {x["chave"] for x in lines} == {"b:1", "a:2"} and all(x["notas"] == "" and "grupo" in x for x in lines)
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "x").write_text("x")
    with pytest.raises(ValueError):
        state.export_payload(parts, f"file://{tmp_path}/mine")
    env = {"GITHUB_SERVER_URL": "https://s", "GITHUB_REPOSITORY": "o/r", "GITHUB_WORKFLOW_REF": "o/r/.github/workflows/p.yml@main"}
    assert state.refresh_url(env) == "https://s/o/r/actions/workflows/p.yml" and state.refresh_url({}) is None


def test_commands_name_rows_that_exist(spark):
    s = rows_of(spark, [{"chave": "f:1", "status": "novo", "notas": ""}])
    for call in (lambda k: commands.set_status(s, k, "visita", "2024"), lambda k: commands.append_note(s, k, "x", "2024-01-02"), lambda k: commands.replace_notes(s, k, "x"), lambda k: commands.annotate(s, k, "x", None, [], "2024"), lambda k: commands.lookup(s, k)):
        with pytest.raises(commands.NotFound):
            call("f:2")
        with pytest.raises(ValueError):
            call("no key")
    with pytest.raises(ValueError):
        commands.set_status(s, "f:1", "vendido", "2024")
    assert commands.parse_request("") == {} and commands.parse_request('{"status":"novo"}')["status"] == "novo"
    for bad in ("[1]", "{", "x" * 100_001):
        with pytest.raises(ValueError):
            commands.parse_request(bad)
    assert commands.parse_flags(["search", "x", "--pages", "2", "--todos"], {"pages", "todos"}, {"pages"}) == (["search", "x"], {"pages": "2", "todos": True})
    for bad in (["--other"], ["--pages", "0"], ["--pages", "x"], ["--pages"]):
        with pytest.raises(ValueError):
            commands.parse_flags(bad, {"pages"}, {"pages"})
    with pytest.raises(ValueError):
        criteria.console_filter(s, status="vendido")
    with pytest.raises(ValueError):
        details.detail("other")
    with pytest.raises(ValueError):
        platforms.platform("other")
    assert config.ad_hoc("msys", "https://www.casa.example.br/") == {"id": "casa", "nome": "www.casa.example.br", "plataforma": "msys", "url": "https://www.casa.example.br", "ativo": True}
    with pytest.raises(ValueError):
        config.ad_hoc("msys", "casa")
    assert config.from_environment({"LOTEWISE_DATA": "d"}) == {"config": "config/sources.json", "data": "d"}
    assert scan.paths_for(["flat", "casa"]) == ["apartamentos-para-alugar", "casas-para-alugar"] and len(scan.paths_for(None)) == 5


def test_run_tells_its_phases(spark):
    c = config.Config(cidade="Botucatu", uf="SP", fontes=[], aluguel_max=2000, tipos=["casa"])
    rows = rows_of(spark, [{"fonte": "a", "id": str(i), "tipo": "casa", "aluguel": 500.0 + i, "cidade": "Botucatu", "titulo": "t", "ord": i} for i in range(4)] + [{"fonte": "a", "id": "9", "tipo": "comercial", "titulo": "t", "ord": 9}])
    batch = rows.select(*[x for x in rows.columns if x not in ("chave", "grupo")])
    batch = merge.default_row(batch, keep=("ord",))
    d = spark.createDataFrame([("a", "0", "longa", None), ("a", "1", None, "sumiu")], "fonte string, id string, descricao string, erro string")
    heard = []
    known = rows_of(spark, [{"chave": "a:3", "fonte": "a", "id": "3", "detalhado": True, "ativo": True, "ord": 1, "aluguel": 503.0}, {"chave": "a:7", "fonte": "a", "id": "7", "ativo": True, "ord": 2}, {"chave": "b:1", "fonte": "b", "id": "1", "ativo": True, "ord": 3}])
    new, log, news = crawl.run(known, {"a": (batch, {"completo": True}), "b": (batch.limit(0), {"erro": "bloqueado"})}, c, "2024-01-01T00:00:00Z", "2024-01-01T00:01:00Z", details=d, on_progress=heard.append)
    got = {r.chave: (r.ativo, r.descricao, r.detalhado) for r in new.collect()}
    assert got == {"a:0": (True, "longa", True), "a:1": (True, None, False), "a:2": (True, None, False), "a:3": (True, None, True), "a:7": (False, None, False), "b:1": (True, None, False)}
    r = log.first()
    assert [x.chave for x in news.orderBy("pos").collect()] == ["a:0", "a:1", "a:2"] and r.novos == 3 and r.fontes["a"].detalhados == 1 and r.fontes["a"].removidos == 1 and r.fontes["a"].atualizados == 1 and r.fontes["a"].avisos == ["detalhe 1: sumiu"] and r.fontes["b"].erro == "bloqueado"
    phases = [h["a"]["fase"] for h in heard]
    assert [p for i, p in enumerate(phases) if (not i or p != phases[i - 1]) and p != "aguardando"] == ["buscando", "detalhando", "ok"]
    assert heard[-1]["a"]["fase"] == "ok" and (heard[-1]["b"]["fase"], heard[-1]["b"]["msg"]) == ("erro", "bloqueado")
    assert any(h["a"].get("detalhados") == 1 and h["a"]["falhas"] == 1 for h in heard) and r.fontes["a"].ms > 0
    with pytest.raises(crawl.Cancelled):
        crawl.run(known, {"a": (batch, {})}, c, "x", "y", stop=lambda: True)
    log2 = commands.append_run(log.limit(0), log)
    assert log2.count() == 1


def test_groups_against_brute_force(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}/c")
    rng = np.random.default_rng(1)
    rows = []
    for i in range(160):
        plat = ["chavesnamao", "msys", "ksi"][int(rng.integers(0, 3))]
        f = {"chavesnamao": "agg", "msys": f"m{int(rng.integers(0, 3))}", "ksi": f"k{int(rng.integers(0, 2))}"}[plat]
        rows.append({"chave": f"{f}:{i}", "id": str(i), "fonte": f, "plataforma": plat, "ord": i, "ativo": bool(rng.random() > 0.1), "aluguel": float(rng.integers(5, 8) * 100), "tipo": ["casa", "sobrado", "apartamento"][int(rng.integers(0, 3))], "bairro": ["Jd. Sol", "Jardim Sol", "Centro", ""][int(rng.integers(0, 4))], "quartos": int(rng.integers(1, 3)), "area": float(rng.choice([48.0, 49.5, 50.0, 51.9, 52.0, 54.1, 100.0, 104.0, 104.2])), "banheiros": [None, 1, 2][int(rng.integers(0, 3))], "vagas": [None, 1][int(rng.integers(0, 2))], "condominio": [None, 100.0, 104.0, 110.0][int(rng.integers(0, 4))], "referencia": f"R-{int(rng.integers(0, 40))}", "anunciante": ["Casa m0 Ltda", "Outra"][int(rng.integers(0, 2))], "detalhado": bool(rng.random() > 0.5), "primeira_vez": f"2024-01-{10 + i % 20}"})
    src = spark.createDataFrame([("m0", 0, "Imobiliária Casa m0", "msys", []), ("m1", 1, "Nada", "msys", [])], "id string, pos int, nome string, plataforma string, apelidos array<string>")
    got = {r.chave: r.grupo for r in resolve.assign_groups(rows_of(spark, rows), src, lambda df: df.checkpoint()).collect()}
    act = [r for r in rows if r["ativo"]]
    fam = {"casa": "casa", "sobrado": "casa", "apartamento": "ap"}
    nb = {"Jd. Sol": "jardim sol", "Jardim Sol": "jardim sol", "Centro": "centro", "": ""}
    eq = lambda a, b: a is None or b is None or a == b
    direct = {(r["fonte"], r["referencia"].replace("-", "")): r for r in act if r["plataforma"] != "chavesnamao"}
    edges = [(r, direct["m0", r["referencia"].replace("-", "")]) for r in act if r["plataforma"] == "chavesnamao" and r["anunciante"] == "Casa m0 Ltda" and ("m0", r["referencia"].replace("-", "")) in direct]
    by = {}
    for r in act:
        by.setdefault(r["aluguel"], []).append(r)
    for same in by.values():
        for i, a in enumerate(same):
            for b in same[i + 1 :]:
                if a["fonte"] != b["fonte"] and fam[a["tipo"]] == fam[b["tipo"]] and nb[a["bairro"]] == nb[b["bairro"]] != "" and abs(a["area"] - b["area"]) <= max(2, 0.04 * max(a["area"], b["area"])) and a["quartos"] == b["quartos"] and eq(a["banheiros"], b["banheiros"]) and eq(a["vagas"], b["vagas"]) and (a["condominio"] is None or b["condominio"] is None or abs(a["condominio"] - b["condominio"]) <= 5):
                    edges.append((a, b))
    sets = {r["chave"]: [r] for r in act}
    for a, b in edges:
        x, y = sets[a["chave"]], sets[b["chave"]]
        if x is not y and not {r["fonte"] for r in x} & {r["fonte"] for r in y}:
            x += y
            for r in y:
                sets[r["chave"]] = x
    rank = lambda r: (r["plataforma"] == "chavesnamao", not r["detalhado"], r["primeira_vez"], r["chave"])
    want = {r["chave"]: None for r in rows} | {k: "g:" + min(s, key=rank)["chave"] if len(s) > 1 else None for k, s in sets.items()}
    assert got == want and sum(v is not None for v in want.values()) > 40


def test_empty_table_of_listings(spark):
    assert [r.linha for r in views.listing_table(rows_of(spark, [{"chave": "f:1"}]).limit(0)).collect()] == ["(nenhum)"]
    assert views.plain_record(rows_of(spark, [{"chave": "f:1", "titulo": "T", "url": "u"}]).withColumn("contatos", F.expr("cast(array(named_struct('nome','A','papel','corretor','telefone','1','whatsapp','2','email',null,'creci','3')) AS array<struct<nome:string,papel:string,telefone:string,whatsapp:string,email:string,creci:string>>)"))).first().texto == "T\n? · R$ ?\n? quartos · ? banh. · ? vagas · ? m²\nContato: A [corretor] 1 wa.me/2  CRECI 3\n\nu"
