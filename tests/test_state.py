from pyspark.sql import functions as F

from lotewise.operators import commands, criteria, merge, resolve, views
from lotewise.sources.shared import stored
from lotewise.schema import LISTING, STATE
from lotewise.sources.state import StateStore
from lotewise.streaming.upsert import upsert_stream

T1, T2 = "2026-09-01T10:00:00.000Z", "2026-09-02T10:00:00.000Z"


def rows(spark, *given, schema=LISTING):
    base = {"tipo": "apartamento", "aluguel": 1500.0, "total": 1500.0, "quartos": 2, "bairro": "Jardim Paraíso", "cidade": "Botucatu", "fonte": "a", "plataforma": "msys", "titulo": "t", "url": "u"}
    names = sorted({k for g in given for k in g} | base.keys())
    from lotewise.schema import columns

    kinds = dict(columns(STATE)) | {"ord": "bigint"}
    data = [tuple((base | g).get(n) for n in names) for g in given]
    df = spark.createDataFrame(data, ", ".join(f"{n} {kinds[n]}" for n in names))
    out = merge.default_row(df, schema)
    return out if schema == STATE else out.withColumn("ord", F.monotonically_increasing_id())


def done(spark, *fontes):
    return spark.createDataFrame([(f, True) for f in fontes], "fonte string, completo boolean")


def empty(spark):
    return spark.createDataFrame([], STATE)


def by_key(df):
    return {r.chave: r for r in df.collect()}


def test_insert_update_deactivate(spark):
    one = merge.apply_results(empty(spark), rows(spark, {"id": "1"}, {"id": "2"}), done(spark, "a"), T1)
    got = by_key(one)
    assert got["a:1"].acao == "inserir" and [tuple(h) for h in got["a:1"].historico_precos] == [("2026-09-01", 1500.0, 1500.0)]
    state = commands.set_status(one.drop("acao"), "a:1", "interesse", T1)
    two = merge.apply_results(state, rows(spark, {"id": "1", "aluguel": 1400.0, "total": 1400.0}), done(spark, "a"), T2)
    got = by_key(two)
    assert [h.aluguel for h in got["a:1"].historico_precos] == [1500.0, 1400.0]
    assert (got["a:1"].status, got["a:1"].primeira_vez, got["a:1"].ultima_vez) == ("interesse", T1, T2)
    assert (got["a:2"].acao, got["a:2"].ativo, got["a:2"].inativo_desde) == ("desativar", False, T2)
    kept = by_key(merge.apply_results(state, rows(spark, {"id": "1"}), done(spark), T2))
    assert kept["a:2"].acao == "manter" and len(kept["a:1"].historico_precos) == 1
    back = by_key(merge.apply_results(two.drop("acao"), rows(spark, {"id": "2"}), done(spark), T2))
    assert back["a:2"].ativo and back["a:2"].inativo_desde is None
    counts = {r.fonte: (r.novos, r.atualizados, r.removidos) for r in merge.run_counts(two).collect()}
    assert counts == {"a": (0, 1, 1)}


def test_merge_policy(spark):
    c = lambda n, p: {"nome": n, "papel": "corretor", "telefone": p, "whatsapp": None, "email": None, "creci": None}
    first = rows(spark, {"id": "1", "descricao": "longa", "condominio": 320.0, "fotos": ["x", "y"], "contatos": [c("Ana", "(14) 3882-0001")], "caracteristicas": ["Piscina"], "lat": -1.0, "lng": -2.0, "detalhado": True, "mobiliado": False})
    state = merge.apply_results(empty(spark), first, done(spark), T1).drop("acao")
    second = rows(spark, {"id": "1", "bairro": None, "fotos": ["z"], "contatos": [c("Imob", "(14) 3882-0002")], "caracteristicas": ["Quintal"], "lat": -5.0})
    r = by_key(merge.apply_results(state, second, done(spark), T2))["a:1"]
    assert (r.descricao, r.condominio, r.total, r.bairro, r.fotos, r.mobiliado) == ("longa", 320.0, 1820.0, None, ["x", "y"], False)
    assert [x.nome for x in r.contatos] == ["Ana", "Imob"] and r.caracteristicas == ["Piscina", "Quintal"]
    assert (r.lat, r.lng, r.detalhado) == (-1.0, -2.0, True)


def test_criteria(spark):
    df = rows(spark, {"id": "1", "aluguel": None}, {"id": "2", "aluguel": 2500.0}, {"id": "3", "titulo": "KITNET boa"}, {"id": "4", "tipo": "comercial"}, {"id": "5", "cidade": "Bauru"}, {"id": "6", "quartos": None}, {"id": "7", "tipo": "outro"})
    got = {r.id: r.tipo for r in criteria.meets_criteria(df, 2000, ["apartamento", "kitnet"], 1, "BOTUCATÚ").collect()}
    assert got == {"1": "apartamento", "3": "kitnet", "6": "apartamento", "7": "outro"}


def test_listing_and_facets(spark):
    st = rows(spark, *[{"id": str(i), "chave": f"a:{i}", "ord": i, "ativo": i != 4, "status": "descartado" if i == 5 else "novo", "grupo": "g:x" if i < 2 else None, "aluguel": [900.0, 800.0, None, 700.0, 1.0, 1.0][i], "primeira_vez": T1, "quartos": None if i == 3 else 2} for i in range(6)], schema=STATE)
    assert [r.chave for r in criteria.listing(st, criteria.facets(), "preco").collect()] == ["a:3", "a:1", "a:2"]
    assert [r.chave for r in criteria.listing(st, criteria.facets(rooms=2, ceiling=850), "preco").collect()] == ["a:1", "a:2"]
    assert criteria.tab_counts(st, ["novo", "descartado"]).first().asDict() == {"todos": 4, "novo": 4, "descartado": 1}
    assert st.where(criteria.facets(text="paraiso jardim")).count() == 4


def test_resolution(spark):
    src = spark.createDataFrame([("d", 0, "msys", "Dupla Imóveis", []), ("g", 1, "chavesnamao", "Agregador", []), ("e", 2, "ksi", "Casa Nova", ["CN Locações"])], "id string, pos int, plataforma string, nome string, apelidos array<string>")
    ads = spark.createDataFrame([("DUPLA Negócios Imobiliários",), ("cn locacoes ltda",), ("Zé",), (None,)], "anunciante string")
    assert {r.anunciante: r.fonte_resolvida for r in resolve.resolve_source(ads, src).collect()} == {"DUPLA Negócios Imobiliários": "d", "cn locacoes ltda": "e"}
    st = rows(
        spark,
        {"id": "1", "chave": "d:1", "fonte": "d", "ord": 0, "ativo": True, "referencia": "AP-7", "area": 45.0},
        {"id": "9", "chave": "g:9", "fonte": "g", "plataforma": "chavesnamao", "ord": 1, "ativo": True, "referencia": "ap7", "aluguel": 1700.0, "anunciante": "Dupla"},
        {"id": "2", "chave": "e:2", "fonte": "e", "plataforma": "ksi", "ord": 2, "ativo": True, "area": 46.0},
        {"id": "3", "chave": "e:3", "fonte": "e", "plataforma": "ksi", "ord": 3, "ativo": True, "area": 45.0},
        {"id": "4", "chave": "d:4", "fonte": "d", "ord": 4, "ativo": False, "area": 45.0},
        {"id": "5", "chave": "d:5", "fonte": "d", "ord": 5, "ativo": True, "area": 60.0},
        schema=STATE,
    )
    got = {r.chave: r.grupo for r in resolve.assign_groups(st, src, lambda df: stored(df, "groups")).collect()}
    assert got == {"d:1": "g:d:1", "g:9": "g:d:1", "e:2": "g:d:1", "e:3": None, "d:4": None, "d:5": None}


def test_views(spark):
    st = rows(spark, {"id": "1", "chave": "a:1", "ord": 0, "ativo": True, "status": "novo", "lat": 1.0, "lng": 3.0, "notas": "x" * 500, "area": 50.0}, {"id": "2", "chave": "a:2", "ord": 1, "ativo": False, "status": "novo", "bairro": "Jd Paraiso", "lat": None, "lng": None}, schema=STATE)
    filled = by_key(views.with_coordinates(st))
    assert (filled["a:2"].lat, filled["a:2"].lng, filled["a:2"].coord_aprox, filled["a:1"].coord_aprox) == (1.0, 3.0, True, False)
    c = by_key(views.compact(st))["a:1"]
    assert c.notas == "…" + "x" * 400 and c.tambem_em == []
    m = views.market_stats(st).collect()
    assert [tuple(r) for r in m] == [("apartamento · 2 quartos", 1, 1500.0, 1500.0, 1500.0, 30.0)]
    s = views.summary(st).first()
    assert (s.total, s.ativos, s.por_status) == (2, 1, {"novo": 1})


def test_commands_and_store(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/state")
    assert store.read().count() == 0
    store.update(lambda s: merge.apply_results(s, rows(spark, {"id": "1"}), done(spark), T1).drop("acao"))
    store.update(lambda s: commands.append_note(commands.annotate(s, "a:1", "bom", 80, ["barulho"], T2), "a:1", " olá ", T2))
    r = store.read().first()
    assert (r.notas, r.ia.nota, r.ia.alertas) == ("[02/09/2026] olá", 80, ["barulho"])
    assert store.versions() == [1, 2]


def test_stream(spark, tmp_path):
    src, store = str(tmp_path / "in"), StateStore(spark, f"file://{tmp_path}/state")
    rows(spark, {"id": "1"}, {"id": "2"}).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    upsert_stream(stream, store, str(tmp_path / "ck"), lambda n: T1, ("a",)).awaitTermination(120)
    assert sorted(r.chave for r in store.read().collect()) == ["a:1", "a:2"]
