import json

import pytest

from lotewise.sources import config, pages, platforms


def test_config(spark):
    c = config.load(json.dumps({"cidade": "X", "uf": "sp", "aluguel_max": 0, "concorrencia": 99, "fontes": [{"id": "a"}, {"id": "b", "ativo": False}]}))
    assert (c.uf, c.aluguel_max, c.concorrencia) == ("SP", 2000, 8)
    assert [r.id for r in config.sources(spark, c).collect()] == ["a"]
    assert [r.nome for r in config.sources(spark, c, ["b"]).collect()] == ["b"]
    for bad in ({"uf": "SP", "cidade": ""}, {"cidade": "X", "uf": "SP", "fontes": [{"id": "A B"}]}, {"cidade": "X", "uf": "SP", "fontes": [{"id": "a"}, {"id": "a"}]}):
        with pytest.raises(ValueError):
            config.load(json.dumps(bad))
    with pytest.raises(ValueError):
        platforms.platform("nope")


def test_charset():
    assert pages.decode_bytes("ação".encode("cp1252"), "text/html; charset=ISO-8859-1") == "ação"
    assert pages.decode_bytes(b'<meta charset="windows-1252">' + "ç".encode("cp1252"), None).endswith("ç")
    assert pages.decode_bytes("ção".encode(), None) == "ção"


def test_msys(spark):
    doc = {"idtProperty": 7, "namCategory": "Terrenos", "namSubCategory": "Padrão", "namDistrict": "VILA ÉDEN", "namCity": "BOTUCATU", "namState": "São Paulo", "valLocation": 900, "valIptuCalculated": 103.89, "valCondominium": 0, "indType": "L", "prop_char_5": 2, "prop_char_95": "50,5", "latitude": "-22.8", "longitude": "-48.4", "flgShowMapSite": 1, "jsonPhotos": '[{"urlPhoto":"a"},{"urlPhoto":"b","flgNotShowSite":1}]', "idtsCharacteristics": "|27||194|", "desInformationSite": "Aceita caução.\r\nOk", "flgReservedLocation": 1}
    df = spark.createDataFrame([(json.dumps(doc), "f", "Imob", "https://x.br")], "j string, fonte string, fonte_nome string, base string").selectExpr("parse_json(j) AS doc", "fonte", "fonte_nome", "base")
    r = platforms.msys(df).first()
    assert (r.id, r.titulo, r.tipo, r.aluguel, r.condominio, r.iptu, r.total) == ("7", "Terreno na Vila Éden", "terreno", 900.0, None, 103.89, 1003.89)
    assert (r.uf, r.cidade, r.lat, r.fotos, r.quartos, r.area, r.mobiliado, r.aceita_pet) == ("SP", "Botucatu", -22.8, ["a"], 2, 50.5, True, True)
    assert (r.url, r.garantias, r.caracteristicas) == ("https://x.br/imovel/locacao/terrenos/botucatu/vila-eden/7", ["Caução"], ["Reservado / em negociação"])


def test_ksi(spark):
    card = '<div class="card card-imo"><a href="/alugar/Botucatu/Apartamento/Kitnet/Centro/123"></a><h2 title="Kit &amp; net">x</h2><div class="card-valores"><p>R$ 300.000,00 V</p><p>R$ 1.800,00 L</p></div></div><i title="2 Dormitórios"></i><i title="40,5 M²"></i><div class="card-bairro-cidade-texto">JARDIM BOM - BOTUCATU/SP</div><img data-flickity-lazyload-src="/foto_thumb/1.jpg"><div class="card-texto"><p>Não aceita animais</p></div>'
    page = f'<title>120 imóveis em Botucatu</title><a href="tel:(14) 3882-0000">x</a>{card}<div class="card card-imo">nada'
    df = spark.createDataFrame([(page, "k", "Imob", "https://k.br")], "html string, fonte string, fonte_nome string, base string")
    (r,) = platforms.ksi(df).collect()
    assert (r.id, r.url, r.titulo, r.tipo, r.subtipo, r.aluguel, r.quartos, r.area) == ("123", "https://k.br/alugar/Botucatu/Apartamento/Kitnet/Centro/123", "Kit & net", "kitnet", "Kitnet", 1800.0, 2, 40.5)
    assert (r.bairro, r.cidade, r.uf, r.fotos, r.aceita_pet) == ("Jardim Bom", "Botucatu", "SP", ["/foto_/1.jpg"], False)
    t = df.select(platforms.ksi_total(df.html), platforms.ksi_phones(df.html)).first()
    assert (t[0], t[1]) == (120, ["(14) 3882-0000"])


def test_aggregator(spark):
    offer = {"url": "https://c.br/imovel/apartamentos-para-alugar-sp-botucatu-com-garagem/id-55/", "name": "Ap", "price": 1500, "offeredBy": {"name": "DUPLA IMOB"}, "itemOffered": {"numberOfBedrooms": 2, "floorSize": {"value": 1}, "address": {"addressLocality": "CENTRO", "addressRegion": "Botucatu, SP"}, "image": "i"}}
    other = offer | {"url": "https://c.br/imovel/casas-para-alugar-sp-bauru/id-56/"}
    ld = {"@type": "RealEstateListing", "offers": {"numberOfItems": 2, "itemListElement": [offer, other]}}
    html = f'<script type="application/ld+json">{{bad</script><script type="application/ld+json">{json.dumps([ld])}</script>'
    (r,) = platforms.aggregator(spark.createDataFrame([(html, "c")], "html string, fonte string"), "botucatu").collect()
    assert (r.id, r.anunciante, r.tipo, r.aluguel, r.quartos, r.vagas, r.area, r.bairro, r.cidade, r.uf, r.fotos) == ("55", "Dupla Imob", "apartamento", 1500.0, 2, None, None, "Centro", "Botucatu", "SP", ["i"])


def test_kenlo(spark):
    data = [{"property_full_reference": "AP1-XY", "rent_price": [1200, 1300], "total_rent": 1350, "property_type": "STUDIO_APARTMENT", "bedrooms": [1, 2], "area": ["57", "60"], "url": "/imovel/1", "amenities": ["POOL", "PET_FRIENDLY"], "rent_guarantee": ["DEPOSIT", "GUARANTOR"], "photos": [{"picture_full": "p"}], "listing_description": "x"}, {"id": 2}]
    state = {"settings": {"listings": {"count": 2, "data": data}}}
    html = f"<script>(function(){{window.markoVars['listings-ab12'] = {json.dumps(state)};\n }})();</script>"
    (r,) = platforms.kenlo(spark.createDataFrame([(html, "k", "Imob", "https://k.br")], "html string, fonte string, fonte_nome string, base string")).collect()
    assert (r.id, r.tipo, r.aluguel, r.total, r.quartos, r.area, r.url, r.referencia) == ("AP1-XY", "kitnet", 1200.0, 1350.0, 1, 57.0, "https://k.br/imovel/1", "AP1")
    assert (r.caracteristicas, r.garantias, r.aceita_pet, r.fotos) == (["Piscina", "Aceita pet"], ["Caução", "Fiador"], True, ["p"])


def test_contacts_and_tags(spark):
    cols = "html string, fonte string, fonte_nome string, base string"
    info = {"email": "a@x.br", "whatsapp": [{"number": "(14) 99644-7985"}], "phone": "(14) 3354-7985 | (14) 99644-7985"}
    names = [{"idtCharacteristics": i, "desCharacteristics": n} for i, n in ((3, "Piscina "), (4, "Mobília"), (5, "Semi mobiliado"), (6, "Dormitórios"))]
    prop = {"idtProperty": 7, "idtsCharacteristics": "|3||4||5||6|", "valLocation": 900, "jsonCharacteristics": json.dumps([{"characteristics": {"idtCharacteristics": 9, "desCharacteristics": "Sacada"}, "desInformation": "Sim"}, {"characteristics": {"idtCharacteristics": 8, "desCharacteristics": "Quintal"}, "desInformation": "Não"}]), "jsonCondominiumCharacteristics": "{bad"}
    brokers = [{"namPerson": "Corretor A", "creci": "1"}, {"namPerson": "Corretor B", "desPhone": "14 90000-0001", "isCaptivatorLocation": 1}]
    template = {"imobInfo": info, "requests": {"allCharacteristics": names}, "fullUrl": "https://y.br/z", "data": {"property": prop, "captivators": brokers}}
    html = f'<script id="__NEXT_DATA__">{json.dumps({"props": {"initialProps": {"pageProps": {"template": template}}}})}</script>'
    page = spark.createDataFrame([(html, "f", "Imob", "https://x.br")], cols)
    docs = spark.createDataFrame([(json.dumps(prop), "f", "Imob", "https://x.br"), (json.dumps(prop), "g", "Other", "https://x.br")], cols.replace("html", "j")).selectExpr("parse_json(j) AS doc", "fonte", "fonte_nome", "base")
    agency = [("(14) 99644-7985", "5514996447985", "a@x.br"), ("(14) 3354-7985", None, "a@x.br")]
    short = lambda r: [(c.telefone, c.whatsapp, c.email) for c in r.contatos]
    with_site = {r.fonte: r for r in platforms.msys(docs, platforms.msys_site(page)).collect()}
    assert short(with_site["f"]) == agency and with_site["f"].caracteristicas == ["Piscina", "Semimobiliado"]
    assert (with_site["g"].contatos, with_site["g"].caracteristicas) == ([], [])
    (r,) = platforms.msys_detail(page.unionByName(page.selectExpr("'<p>' AS html", "fonte", "fonte_nome", "base"))).collect()
    assert [(c.nome, c.papel, c.creci) for c in r.contatos] == [("Corretor B", "corretor", None), ("Corretor A", "corretor", "1"), ("Imob", "imobiliaria", None), ("Imob", "imobiliaria", None)]
    assert short(r)[2:] == agency and r.caracteristicas == ["Piscina", "Semimobiliado", "Sacada"] and r.detalhado and r.url.startswith("https://y.br/imovel/")
    page = '<a href="tel:(14) 3882-0000"></a><a href="tel:(14) 99000-0001"></a><a href="tel:(14) 3882-0002"></a><div class="card card-imo"><a href="/alugar/B/Casa/Casa/Centro/1"></a>'
    (r,) = platforms.ksi(spark.createDataFrame([(page, "k", "Imob", "https://k.br")], cols)).collect()
    assert short(r) == [("(14) 3882-0000", None, None), ("(14) 99000-0001", "5514990000001", None)]
    state = {"website": {"chat_whatsapp_phone": "14 3882-0000"}, "offices": [{"phones": [{"number": "14 3882-0001"}, {"number": "14 3882-0002", "show": False}, {"number": "14 3882-0003", "whatsapp": True}]}], "settings": {"listings": {"data": [{"property_full_reference": "A"}]}}}
    page = f"window.markoVars['listings-ab12'] = {json.dumps(state)};\n }})();"
    (r,) = platforms.kenlo(spark.createDataFrame([(page, "k", "Imob", "https://k.br")], cols)).collect()
    assert short(r) == [("(14) 3882-0000", "551438820000", None), ("(14) 3882-0001", None, None), ("(14) 3882-0003", "551438820003", None)]


def test_payload(spark):
    df = spark.createDataFrame([('"reference":"A\\1","x":12.5,"y":"$undefined","rooms":{"count":3}',)], "t string")
    r = df.select(*[pages.payload_field(df.t, k) for k in ("x", "y", "z")], pages.payload_count(df.t, "rooms")).first()
    assert tuple(r) == ("12.5", None, None, 3)
