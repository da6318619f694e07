"""Queries of the parsers and scans over captures written from the benchmark tables, one for each row; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import merge
from ..sources import captured, details, platforms, scan
from ..sources.pages import json_ld, next_data
from ..sources.shared import once, shared_folder, stored
from .facade import table
from .queries import query


def _br(c: str) -> str:
    """A number in Brazilian notation, as an expression."""
    return f"translate(format_number({c}, 2), ',.', '.,')"


#: Captures that one task parses: rows of the tables are a few bytes each, so a file that Spark takes for one task can hold a million pages.
CAPTURES = 8192


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out evenly, ``CAPTURES`` a partition, however their files are cut; they are counted from the files' footers."""
    return rows.repartition(max(1, -(-rows.count() // CAPTURES)))


def _captures(spark: SparkSession, sf_dir: str, html: str) -> DataFrame:
    """One capture a part."""
    rows = _spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"))
    return once(rows.selectExpr("concat('', p_partkey) AS id", "'sai' AS fonte", "'Casa Boa Imóveis' AS fonte_nome", "'https://sai.example' AS base", f"{html} AS html", "p_partkey AS page"))


def _join(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


_PHONE = "'(14) 3', lpad(concat('', p_partkey % 1000), 3, '0'), '-', lpad(concat('', p_size), 4, '0')"
_MOBILE = "'(14) 9', lpad(concat('', p_partkey % 10000), 4, '0'), '-', lpad(concat('', p_size), 4, '0')"
_E164 = "'55149', lpad(concat('', p_partkey % 10000), 4, '0'), lpad(concat('', p_size), 4, '0')"
_R2 = "floor(({}) * 100 + 0.5e0) / 100.0e0"

_KSI_DETAIL = f"""concat('<script>Aluguel</script><p>Aluguel</p><p>', {_br('p_retailprice')}, '</p><p>Condom&iacute;nio</p><p>', CASE WHEN p_size % 5 = 0 THEN '0,00' ELSE concat('', p_size * 10, ',50') END,
 '</p><p>IPTU</p><p>', CASE WHEN p_partkey % 2 = 0 THEN 'isento' ELSE '33,23' END, '</p>', CASE WHEN p_partkey % 3 = 0 THEN '<td>Total / M&ecirc;s</td><td>5.000,10</td>' ELSE '' END,
 '<i>', p_size % 5, '</i> <i>Dormit&oacute;rios</i><i>1</i><i>Banheiro</i><b>', p_size, ',50</b><b>A. &Uacute;til</b><h3>Itens do Im&oacute;vel</h3><li>Piscina</li><li>  Arm&aacute;rio   embutido </li><li>', repeat('x', 61), '</li><h3>Itens do Edif&iacute;cio Sol</h3><li>Ed. Sol</li><li>Lazer</li><li>Piscina</li><li>Elevador</li><h3>Fale com a gente</h3>',
 CASE WHEN p_partkey % 4 = 0 THEN '<b>RESERVADO</b>' ELSE '<b>DISPON&Iacute;VEL</b>' END, '<h4>CORRETOR RESPONS&Aacute;VEL</h4><p>', 'Ana ', p_size, ' - Loca&ccedil;&atilde;o</p><p>CRECI ', p_partkey, '-F</p><a href="tel:', {_PHONE}, '">x</a>',
 '<script type="application/ld+json">{{"@type":"Product","description":"Casa ', p_partkey, '\\\\nAceita pets","image":["a.jpg"," b.jpg ","a.jpg"],"offers":{{"price":1}}}}</script>')"""


@query(
    f"""SELECT concat('', p_partkey) AS id, p_retailprice AS aluguel, CASE WHEN p_size % 5 <> 0 THEN p_size * 10 + 0.5e0 END AS condominio, CASE WHEN p_partkey % 2 <> 0 THEN 33.23e0 END AS iptu,
    CASE WHEN p_partkey % 3 = 0 THEN 5000.1e0 ELSE {_R2.format("p_retailprice + CASE WHEN p_size % 5 <> 0 THEN p_size * 10 + 0.5e0 ELSE 0 END + CASE WHEN p_partkey % 2 <> 0 THEN 33.23e0 ELSE 0 END")} END AS total,
    p_size % 5 AS quartos, CAST(NULL AS INTEGER) AS suites, 1 AS banheiros, p_size + 0.5e0 AS area, concat(CASE WHEN p_partkey % 4 = 0 THEN 'Reservado|' ELSE '' END, 'Piscina|Armário embutido|Elevador') AS caracteristicas,
    concat('Ana ', p_size, '/corretor/', p_partkey, '-F|Casa Boa Imóveis/imobiliaria/', {_PHONE}) AS contatos, concat('Casa ', p_partkey, chr(10), 'Aceita pets') AS descricao, true AS aceita_pet, 'a.jpg|b.jpg' AS fotos FROM part"""
)
def ksi_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details.detail("ksi")(_captures(spark, sf_dir, _KSI_DETAIL))
    people = F.array_join(F.transform("contatos", lambda c: F.concat_ws("/", c["nome"], c["papel"], c["telefone"], c["creci"])), "|").alias("contatos")
    return d.select("id", "aluguel", "condominio", "iptu", "total", "quartos", "suites", "banheiros", "area", _join("caracteristicas"), people, "descricao", "aceita_pet", _join("fotos"))


_CNM_DETAIL = f"""concat('<script type="application/ld+json">{{"@type":"RealEstateListing","description":"Lindo &amp; novo\\\\r\\\\n  aceita pets","datePosted":"2024-01-0', 1 + p_size % 9, '","about":{{"image":"f.jpg","offers":{{"price":', p_retailprice,
 ',"offeredBy":{{"name":"Z&Eacute;LIA EXEMPLO DE SOUZA","telephone":"', {_MOBILE}, '"}},"itemOffered":{{"numberOfBedrooms":', p_size % 4, ',"geo":{{"latitude":"-22.5","longitude":0}},"amenityFeature":[{{"name":"Piscina","value":true}},{{"name":"Sauna","value":false}},{{"name":"Mobiliado"}}]}}}}}}}}</script>',
 '<script>self.push("{{\\\\"reference\\\\":\\\\"AL-', p_partkey, '\\\\",\\\\"condominiumFee\\\\":', p_size * 10, ',\\\\"iptuValue\\\\":0,\\\\"creci\\\\":\\\\"$undefined\\\\",\\\\"suites\\\\":{{\\\\"count\\\\":', p_size % 3, '}},\\\\"whatsapp\\\\":[\\\\"', {_MOBILE}, '\\\\"],\\\\"useful\\\\":\\\\"', p_size, ',5\\\\"',
 CASE WHEN p_partkey % 2 = 0 THEN ',\\\\"neighborhood\\\\":{{\\\\"id\\\\":7,\\\\"name\\\\":\\\\"Centro\\\\",\\\\"url\\\\":\\\\"/c\\\\",\\\\"geoposition\\\\":{{\\\\"lon\\\\":\\\\"-48.25\\\\",\\\\"lat\\\\":\\\\"-22.75\\\\"}}}}' ELSE '' END, '}}")</script>')"""


@query(
    f"""SELECT concat('', p_partkey) AS id, 'Zélia Exemplo de Souza' AS anunciante, concat('AL-', p_partkey) AS referencia, p_retailprice AS aluguel, CASE WHEN p_size > 0 THEN p_size * 10.0e0 END AS condominio, CAST(NULL AS DOUBLE) AS iptu, {_R2.format("p_retailprice + p_size * 10")} AS total,
    p_size % 4 AS quartos, p_size % 3 AS suites, concat('Lindo & novo', chr(10), 'aceita pets') AS descricao, 'Piscina|Mobiliado' AS caracteristicas, true AS mobiliado, true AS aceita_pet, concat('Zélia Exemplo de Souza/', {_MOBILE}, '/', {_E164}) AS contatos,
    concat('2024-01-0', 1 + p_size % 9) AS publicado_em, CASE WHEN p_partkey % 2 = 0 THEN -22.75e0 ELSE -22.5e0 END AS lat, CASE WHEN p_partkey % 2 = 0 THEN -48.25e0 END AS lng, true AS coord_aprox, 'f.jpg' AS fotos, p_size + 0.5e0 AS area FROM part"""
)
def aggregator_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details.detail("chavesnamao")(_captures(spark, sf_dir, _CNM_DETAIL))
    people = F.array_join(F.transform("contatos", lambda c: F.concat_ws("/", c["nome"], c["telefone"], c["whatsapp"], c["creci"])), "|").alias("contatos")
    return d.select("id", "anunciante", "referencia", "aluguel", "condominio", "iptu", "total", "quartos", "suites", "descricao", _join("caracteristicas"), "mobiliado", "aceita_pet", people, "publicado_em", "lat", "lng", "coord_aprox", _join("fotos"), "area")


_KENLO_ROW = """'{"property_full_reference":"AP', p_partkey, '-XYZJ","url":"/imovel/', p_partkey, '","website_title":"Apto &quot;', p_size, '&quot;","property_type":"', CASE WHEN p_size % 2 = 0 THEN 'APARTMENT' ELSE 'STUDIO_APARTMENT' END, '","rent_price":[', p_retailprice, ',9999],"total_rent":', p_retailprice + 100, ',"bedrooms":["', p_size % 4, '"],"area":[', p_size, '],"neighborhood":"VILA DOS LAVRADORES","city":"Botucatu","state":"SP","photos":[{"picture_full":"a"},{"picture_full_fallback":"b"}],"amenities":["POOL","X","FURNISHED"],"rent_guarantee":["GUARANTOR","BOND_INSURANCE"],"listing_description":"Seguro fian&ccedil;a"'"""
_KENLO_PEOPLE = f""""website":{{"chat_whatsapp_phone":"', {_MOBILE}, '"}},"offices":[{{"phones":[{{"number":"', {_PHONE}, '"}},{{"number":"(14) 3000-0000","show":false}}]}}]"""


@query(
    f"""SELECT concat('AP', p_partkey, '-XYZJ') AS id, concat('https://sai.example/imovel/', p_partkey) AS url, concat('Apto "', p_size, '"') AS titulo, CASE WHEN p_size % 2 = 0 THEN 'apartamento' ELSE 'kitnet' END AS tipo, p_retailprice AS aluguel, p_retailprice + 100 AS total, p_size % 4 AS quartos, p_size * 1.0e0 AS area,
    'Vila dos Lavradores' AS bairro, 'a|b' AS fotos, 'Piscina|Mobiliado' AS caracteristicas, true AS mobiliado, 'Fiador|Seguro-fiança' AS garantias, concat('AP', p_partkey) AS referencia, concat('Casa Boa Imóveis/', {_MOBILE}, '/', {_E164}, '|Casa Boa Imóveis/', {_PHONE}) AS contatos, 147 AS anunciados FROM part"""
)
def kenlo_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = f"""concat('<script>(function(){{\n window.markoVars[\\'listings-ab1\\'] = {{{_KENLO_PEOPLE},"settings":{{"listings":{{"count":147,"data":[', {_KENLO_ROW}, '}}]}}}}}};\n}})();</script>')"""
    pages = _captures(spark, sf_dir, html).withColumn("anunciados", platforms.kenlo_total(F.col("html")))
    d = platforms.kenlo(pages, keep=("anunciados",))
    return d.select("id", "url", "titulo", "tipo", "aluguel", "total", "quartos", "area", "bairro", _join("fotos"), _join("caracteristicas"), "mobiliado", _join("garantias"), "referencia", _people("nome", "telefone", "whatsapp"), "anunciados")


def _people(*fields: str) -> Column:
    return F.array_join(F.transform("contatos", lambda c: F.concat_ws("/", *[c[f] for f in fields])), "|").alias("contatos")


@query(
    f"""SELECT concat('AP', p_partkey, '-XYZJ') AS id, concat('https://full.example/imovel/', p_partkey) AS url, p_retailprice AS aluguel, p_size * 2.0e0 AS condominio, CAST(NULL AS DOUBLE) AS iptu, {_R2.format("p_retailprice + p_size * 2")} AS total, -22.5e0 AS lat, -48.5e0 AS lng, true AS detalhado,
    concat('Corretor A/corretor/', {_MOBILE}, '/', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE concat({_E164}, '/') END, '238392|Só Nome/corretor/9', CASE WHEN p_partkey % 2 = 0 THEN concat('|Casa Boa Imóveis/imobiliaria/', {_PHONE}) ELSE concat('|Casa Boa Imóveis/imobiliaria/', {_PHONE}) END) AS contatos FROM part"""
)
def kenlo_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = f"""concat('<script>\n window.markoVars[\\'listing-details-x9\\'] = {{"server":{{"full_url":"https://full.example/x/y"}},"offices":[{{"phones":[{{"number":"', {_PHONE}, '"}}]}}],"settings":{{"listing":[', {_KENLO_ROW},
     ',"condo_fees":"', {_br('p_size * 2')}, '","property_tax":0,"location":{{"lat":"-22.5","lon":-48.5}},"brokers":[{{"broker_name":"Corretor A","broker_mobile_phone":"', {_MOBILE}, '","broker_credential":238392', CASE WHEN p_partkey % 2 = 0 THEN ',"broker_whatsapp":false' ELSE '' END, '}},{{"broker_name":"Só Nome","broker_credential":"9"}},{{"broker_name":"Ninguém"}}]}}]}}}};\n}})();</script>')"""
    d = details.detail("kenlo")(_captures(spark, sf_dir, html))
    return d.select("id", "url", "aluguel", "condominio", "iptu", "total", "lat", "lng", "detalhado", _people("nome", "papel", "telefone", "whatsapp", "creci"))


_TEMPLATE = f"""concat('<script id="__NEXT_DATA__" type="application/json">{{"props":{{"initialProps":{{"pageProps":{{"template":{{"imob":"rb","fullUrl":"https://rb.example/imovel/9","imobInfo":{{"email":"a@b.c","whatsapp":[{{"number":"', {_MOBILE}, '"}}],"phone":"', {_PHONE}, ' | (14) 3111-2222"}},
 "requests":{{"allCharacteristics":[{{"idtCharacteristics":3,"desCharacteristics":" Mobília "}},{{"idtCharacteristics":4,"desCharacteristics":"Semi mobiliado"}},{{"idtCharacteristics":5,"desCharacteristics":"Cor da parede"}},{{"idtCharacteristics":6,"desCharacteristics":"Lavanderias"}}]}},
 "data":{{"initialPlaces":[{{"city":{{"namCity":"São Manuel","idtCity":1}}}},{{"city":{{"namCity":"BOTUCATU","idtCity":', p_partkey, '}}}}],"initialData":{{"idtCityList":[77]}},
 "captivators":[{{"namPerson":"Vende","desPhone":"(14) 3222-3333"}},{{"namPerson":"Aluga","desPhone":"', {_MOBILE}, '","creci":"12","isCaptivatorLocation":true}}],
 "property":{{"idtProperty":', p_partkey, ',"indType":"L","namCategory":"Apartamentos","namSubCategory":"Padrão","namDistrict":"VILA ÉDEN","namCity":"Botucatu","namState":"São Paulo","valLocation":', p_retailprice, ',"valCondominium":', p_size, ',"valMonthIptu":0,"prop_char_5":', p_size % 4, ',"totalGarages":1,"prop_char_95":', p_size, '.5,"idtsCharacteristics":"|3||5|', CASE WHEN p_partkey % 2 = 0 THEN '|4|' ELSE '' END, '","jsonPhotos":"[{{\\\\"urlPhoto\\\\":\\\\"a\\\\"}},{{\\\\"urlPhoto\\\\":\\\\"b\\\\",\\\\"flgNotShowSite\\\\":1}}]",
 "jsonCharacteristics":"[{{\\\\"characteristics\\\\":{{\\\\"idtCharacteristics\\\\":6}},\\\\"desInformation\\\\":\\\\"Sim\\\\"}},{{\\\\"characteristics\\\\":{{\\\\"desCharacteristics\\\\":\\\\"Portaria 24 Hrs\\\\"}},\\\\"desInformation\\\\":\\\\"', CASE WHEN p_partkey % 3 = 0 THEN 'Não' ELSE 'Sim' END, '\\\\"}}]","latitude":"-22.5","longitude":"-48.5","flgShowMapSite":', p_partkey % 2, '}}}}}}}}}}}}}}</script>')"""
_SITE = f"'Imob Teste/', {_MOBILE}, '/', {_E164}, '/a@b.c|Imob Teste/', {_PHONE}, '/a@b.c|Imob Teste/(14) 3111-2222/a@b.c'"


@query(f"SELECT concat('', p_partkey) AS id, 'rb' AS imob, concat({_SITE}) AS contatos, 'Mobília|Semi mobiliado|Cor da parede|Lavanderias' AS nomes, p_partkey::INTEGER AS cidade, CASE WHEN p_partkey % 2 = 0 THEN 77 END AS outra FROM part")
def msys_site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City pages: the agency's contacts, the characteristic dictionary, and the id of a city by name or else the first of a list."""
    pages = _captures(spark, sf_dir, _TEMPLATE).withColumns({"fonte": F.col("id"), "fonte_nome": F.lit("Imob Teste")})
    read = once(pages.select("id", "page", F.try_variant_get(next_data(F.col("html")), "$.props.initialProps.pageProps.template", "variant").alias("t")))
    t = F.col("t")
    city = read.select(F.col("id").alias("fonte"), platforms.msys_place(t, F.lit("Botucatu")).alias("cidade"), F.when(F.col("page") % 2 == 0, platforms.msys_place(t, F.lit("Bauru"))).alias("outra"))
    site = platforms.msys_site(pages).withColumnRenamed("site_contatos", "contatos")
    return site.join(city, "fonte").select(F.col("fonte").alias("id"), "imob", _people("nome", "telefone", "whatsapp", "email"), F.array_join(F.transform("site_nomes", lambda x: x["nome"]), "|").alias("nomes"), "cidade", "outra")


@query(
    f"""SELECT concat('', p_partkey) AS id, concat('https://rb.example/imovel/locacao/apartamentos/botucatu/vila-eden/', p_partkey) AS url, 'Apartamento na Vila Éden' AS titulo, 'apartamento' AS tipo, p_retailprice AS aluguel, p_size * 1.0e0 AS condominio, CAST(NULL AS DOUBLE) AS iptu, {_R2.format("p_retailprice + p_size")} AS total, p_size % 4 AS quartos, 1 AS vagas, p_size + 0.5e0 AS area, 'SP' AS uf,
    CASE WHEN p_partkey % 2 = 1 THEN -22.5e0 END AS lat, 'a' AS fotos, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Semimobiliado' ELSE 'Mobiliado' END, '|Lavanderia', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '|Portaria 24 Hrs' END) AS caracteristicas, true AS detalhado,
    concat('Aluga/', {_MOBILE}, '/', {_E164}, '/a@b.c/12|Vende/(14) 3222-3333|Imob Teste/', {_PHONE}, '/a@b.c|Imob Teste/(14) 3111-2222/a@b.c') AS contatos FROM part"""
)
def msys_detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = details.detail("msys")(_captures(spark, sf_dir, _TEMPLATE).withColumn("fonte_nome", F.lit("Imob Teste")))
    return d.select("id", "url", "titulo", "tipo", "aluguel", "condominio", "iptu", "total", "quartos", "vagas", "area", "uf", "lat", _join("fotos"), _join("caracteristicas"), "detalhado", _people("nome", "telefone", "whatsapp", "email", "creci"))


@query(
    f"""SELECT concat('', p_partkey, '-', n) AS id, CASE WHEN n = 1 THEN 'kitnet' ELSE 'casa' END AS tipo, p_retailprice + n AS aluguel, p_size % 5 AS quartos, p_size + 0.5e0 AS area, 'Vila São Pedro' AS bairro, 'Botucatu' AS cidade, 'SP' AS uf, 'p/foto_/1' AS fotos, concat('Casa & ', n) AS titulo, concat('Casa Boa Imóveis/', {_PHONE}) AS contatos, 1234 AS anunciados
    FROM part, (SELECT unnest([1, 2]) AS n)"""
)
def ksi_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cards a page, and one that is no rental."""
    card = "concat('<div class=\"card card-imo\"><a href=\"/alugar/Botucatu/', {kind}, '/VILA/', p_partkey, '\"></a>C&oacute;d. <strong>', p_partkey, '-{n}</strong><h2 title=\"Casa &amp; {n}\"></h2><div class=\"card-valores\"><div>R$ 900.000,00 V</div><div>R$ ', {price}, ' L</div></div><i title=\"', p_size % 5, ' Dormit&oacute;rios\"></i><i title=\"', p_size, ',50 M&sup2;\"></i><div class=\"card-bairro-cidade-texto\"><b>VILA S&Atilde;O PEDRO</b> - Botucatu/SP</div><img data-flickity-lazyload-src=\"p/foto_thumb/1\">')"
    parts = [card.format(kind="'Apartamento/KITNET'", n=1, price=_br("p_retailprice + 1")), card.format(kind="'Casa/Casa'", n=2, price=_br("p_retailprice + 2"))]
    html = f"""concat('<title>1.234 im&oacute;veis em Botucatu</title><a href="tel:', {_PHONE}, '"></a>', {', '.join(parts)}, '<div class="card card-imo"><a href="/vender/x/1"></a></div>')"""
    pages = _captures(spark, sf_dir, html).withColumn("anunciados", platforms.ksi_total(F.col("html")))
    d = platforms.ksi(pages, keep=("anunciados",))
    return d.select("id", "tipo", "aluguel", "quartos", "area", "bairro", "cidade", "uf", _join("fotos"), "titulo", _people("nome", "telefone"), "anunciados")


@query(
    """SELECT concat('', p_partkey) AS id, 'Exemplo Negócios' AS anunciante, 'apartamento' AS tipo, p_retailprice AS aluguel, p_size % 4 AS quartos, 0 AS vagas, CASE WHEN p_size > 1 THEN p_size * 1.0e0 END AS area, 'Centro' AS bairro, 'Botucatu' AS cidade, 'SP' AS uf, 'i.jpg' AS fotos, 461 AS anunciados FROM part"""
)
def aggregator_list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An offer of the city, one of another city and one for sale a page."""
    offer = """'{{"url":"https://x/imovel/apartamento-{what}-{city}-centro/id-', p_partkey, '/","price":', p_retailprice, ',"name":"A","offeredBy":{{"name":"EXEMPLO NEG&Oacute;CIOS"}},"itemOffered":{{"numberOfBedrooms":', p_size % 4, ',"image":"i.jpg","floorSize":{{"value":', p_size, '}},"address":{{"addressRegion":"Botucatu, SP","addressLocality":"Centro"}}}}}}'"""
    offers = ", ',', ".join(offer.format(what=w, city=c) for w, c in (("para-alugar", "sp-botucatu"), ("para-alugar", "sp-bauru"), ("a-venda", "sp-botucatu")))
    html = f"""concat('<script type="application/ld+json">{{"@graph":[{{"@type":"WebPage"}},{{"@type":"RealEstateListing","offers":{{"numberOfItems":461,"itemListElement":[', {offers}, ']}}}}]}}</script>')"""
    pages = _captures(spark, sf_dir, html).withColumn("anunciados", platforms.aggregator_total(F.col("html")))
    d = platforms.aggregator(pages, "sp-botucatu", keep=("anunciados",))
    return d.select("id", "anunciante", "tipo", "aluguel", "quartos", "vagas", "area", "bairro", "cidade", "uf", _join("fotos"), "anunciados")


@query("SELECT page_id, CAST(3 + page_id % 2 AS INTEGER) AS n, page_id AS first, CASE WHEN page_id % 2 = 0 THEN 'a b' END AS repaired FROM pages")
def jsonld_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of two, an array of two or a block with a raw line end, and a block that is no JSON, before each page's own html."""
    page = F.expr("""concat('<script type="application/ld+json">{"@graph":[{"@type":"A","n":', page_id, '},{"@type":"B"}]}</script><script type=application/ld+json>{oops</script><script type="application/ld+json">', CASE WHEN page_id % 2 = 0 THEN concat('{"t":"a', chr(10), 'b"}') ELSE '[{"x":1},{"y":2}]' END, '</script>', coalesce(html, ''))""")
    items = json_ld(page)
    rows = table(spark, sf_dir, "pages").select("page_id", items.alias("i"))
    return rows.select("page_id", F.size("i").cast("int").alias("n"), F.try_variant_get(F.get("i", F.lit(0)), "$.n", "bigint").alias("first"), F.try_variant_get(F.get("i", F.lit(2)), "$.t", "string").alias("repaired"))


@query("SELECT p_partkey, concat(p_name, ' & <', p_size, '> – A', chr(233), 'é &nada; &') AS decodificado, concat(p_name, ' & x') AS linha FROM part")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("concat(p_name, ' &amp; &lt;', p_size, '&gt; &ndash; &#65;&#xE9;&#233;&#0;&shy; &nada; &')")
    line = F.expr("concat('  ', p_name, chr(10), chr(9), '&amp;&nbsp; x ')")
    return table(spark, sf_dir, "part").select("p_partkey", text.decode_entities(raw).alias("decodificado"), text.inline(line).alias("linha"))


#: Sightings as entries of result pages: a supplier's group is a source, a line number a page.
_ENTRIES = "SELECT concat('f', l_suppkey % 40) AS fonte, l_linenumber AS page, l_orderkey AS pos, concat('', l_partkey % 60) AS id FROM lineitem"
_PAGES = """SELECT fonte, page, CASE WHEN fonte = 'f3' AND page = 4 THEN 404 WHEN fonte = 'f5' AND page = 3 THEN 403 WHEN fonte = 'f6' AND page = 2 THEN 500 ELSE 200 END AS status, {total} AS total, count(*) AS entradas FROM e WHERE NOT (fonte = 'f7' AND page = 2) GROUP BY 1, 2"""
_TOTAL = "CASE WHEN fonte IN ('f1', 'f2') THEN 30 WHEN fonte = 'f9' THEN NULL ELSE 1000 END"


def _scan_sql(kind: str) -> str:
    """Straight from the rule: running counts of new ids, and the pages before the first that ends the scan."""
    pages = _PAGES.format(total=_TOTAL)
    if kind == "kenlo":  # a page whose state is missing is an error
        pages = pages.replace("ELSE 200 END AS status", "WHEN fonte = 'f8' AND page = 3 THEN 500 ELSE 200 END AS status")
    end = {"msys": "entradas < 50", "ksi": "novos = 0", "kenlo": "entradas < 12"}[kind]
    goal = "last_value(total IGNORE NULLS) OVER w" if kind == "msys" else "first_value(total) OVER w"
    done = "(arg_max(alvo, page) IS NULL OR bool_or(alcancado))" if kind == "msys" else "bool_or(fim AND status IN (200, 404))"
    return f"""WITH e AS ({_ENTRIES}), p AS ({pages}), n AS (SELECT fonte, page, count(*) AS novos FROM (SELECT fonte, id, min(page) AS page FROM e GROUP BY 1, 2) GROUP BY 1, 2),
    q AS (SELECT p.*, coalesce(novos, 0) AS novos FROM p LEFT JOIN n ON p.fonte = n.fonte AND p.page = n.page),
    r AS (SELECT *, sum(novos) OVER w AS lidos, {goal} AS alvo, row_number() OVER w AS k FROM q WINDOW w AS (PARTITION BY fonte ORDER BY page)),
    s AS (SELECT *, coalesce(lidos >= alvo, false) AS alcancado, status <> 200 OR coalesce(lidos >= alvo, false) OR k <> page OR {end} AS fim FROM r),
    t AS (SELECT *, coalesce(max(fim::INT) OVER (PARTITION BY fonte ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS antes FROM s)
    SELECT fonte, CAST(count(*) FILTER (status = 200) AS INTEGER) AS paginas, CAST(coalesce(sum(novos) FILTER (status = 200), 0) AS INTEGER) AS encontrados, arg_max(alvo, page) AS total, {done} AND count(*) FILTER (status IN (403, 500)) = 0 AS completo,
        max(CASE status WHEN 403 THEN 'bloqueado' WHEN 500 THEN 'erro' END) AS erro FROM t WHERE antes = 0 AND page = k GROUP BY 1"""


#: An entry of a result page as each platform writes it, and the page around its entries; null totals are not written.
_ENTRY = {
    "msys": """concat('{"idtProperty":', id, '}')""",
    "ksi": """concat('<div class="card card-imo"><a href="/alugar/Botucatu/Casa/VILA/', id, '"></a>C&oacute;d. <strong>', id, '</strong></div>')""",
    "kenlo": """concat('{"property_full_reference":"', id, '"}')""",
    "chavesnamao": """concat('{"url":"https://x.example/imovel/casa-para-alugar-sp-botucatu-centro/id-', id, '/","price":', aluguel, '}')""",
}
_AROUND = {
    "msys": """concat('{"response":{', coalesce(concat('"numFound":', total, ','), ''), '"docs":[', entries, ']}}')""",
    "ksi": """concat(coalesce(concat('<title>', total, ' im&oacute;veis</title>'), ''), entries)""",
    "kenlo": """CASE WHEN fonte = 'f8' AND page = 3 THEN '<html>' ELSE concat('<script>(function(){\\n window.markoVars[\\'listings-ab1\\'] = {"settings":{"listings":{', coalesce(concat('"count":', total, ','), ''), '"data":[', entries, ']}}};\\n})();</script>') END""",
    "chavesnamao": """concat('<script type="application/ld+json">{"@type":"RealEstateListing","offers":{', coalesce(concat('"numberOfItems":', total, ','), ''), '"itemListElement":[', entries, ']}}</script>')""",
}
_STATUS = "CASE WHEN fonte = 'f3' AND page = 4 THEN 404 WHEN fonte = 'f5' AND page = 3 THEN 403 WHEN fonte = 'f6' AND page = 2 THEN 500 ELSE 200 END"
_CITY = {"cidade": "Botucatu", "uf": "SP"}


def _site(kind: str, n: int) -> dict:
    return {"id": f"f{n}", "nome": f"F{n}", "plataforma": kind, "url": f"https://f{n}.example", "cidades": {"botucatu": 77}}


def _searched(spark: SparkSession, kind: str, entries: DataFrame, sources: int, total: str, **asked) -> DataFrame:
    """The pages of a search over captures written from entries (fonte, caminho, page, pos, id, ...), each under the request it answers."""
    sites = [_site(kind, n) for n in range(sources)]
    wishes = {k: v for k, v in asked.items() if k == "aluguel_max"}
    # every path is captured, whatever types are asked for
    known = [(r.fonte, r.caminho, r.page, r.url, r.corpo) for s in sites for r in captured.requests(s, captured.Ask(**_CITY, **wishes))]
    answers = spark.createDataFrame(known, "fonte string, caminho string, page int, url string, corpo string")
    between = "" if kind == "ksi" else ","
    page = entries.withColumn("entry", F.expr(_ENTRY[kind])).groupBy("fonte", "caminho", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), between).alias("entries"))
    page = page.withColumn("total", F.expr(total)).withColumn("status", F.expr(_STATUS if kind != "chavesnamao" else "200"))
    html = F.when(F.col("status") == 403, "<title>Just a moment...</title>").when(F.col("status") != 200, "<html>").otherwise(F.expr(_AROUND[kind]))
    made = page.withColumn("html", html).alias("p").join(F.broadcast(answers).alias("a"), F.expr("p.fonte = a.fonte AND p.page = a.page AND p.caminho <=> a.caminho"))  # a row for each request
    path = shared_folder(spark, "captures")
    captured.write_captures(made.select("p.fonte", "p.page", "p.caminho", "url", "corpo", "status", "html"), path)
    return captured.search(spark, path, sites, _CITY["cidade"], uf=_CITY["uf"], **asked)


def _pages_of(spark: SparkSession, sf_dir: str, kind: str, **asked) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_suppkey % 40) AS fonte", "CAST(NULL AS STRING) AS caminho", "CAST(l_linenumber AS INT) AS page", "l_orderkey AS pos", "concat('', l_partkey % 60) AS id")
    return _searched(spark, kind, e.where("NOT (fonte = 'f7' AND page = 2)"), 40, _TOTAL, **asked)


def _scanned(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A scan of captured pages, read through the data source and parsed."""
    rows, sources = scan.search(stored(_pages_of(spark, sf_dir, kind, aluguel_max=2500.0), "pages"), kind)
    kept = rows.groupBy("fonte").agg(F.count(F.lit(1)).cast("int").alias("linhas"))
    # the rows kept are those that the counts say
    both = sources.join(kept, "fonte", "left").withColumn("encontrados", F.when(F.coalesce("linhas", F.lit(0)) == F.col("encontrados"), F.col("encontrados")).otherwise(-1))
    return both.select("fonte", "paginas", "encontrados", "total", "completo", "erro")


@query(_scan_sql("ksi"))
def scan_ksi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "ksi")


@query(_scan_sql("msys"))
def scan_msys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "msys")


@query(_scan_sql("kenlo"))
def scan_kenlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scanned(spark, sf_dir, "kenlo")


@query(
    f"""WITH e AS ({_ENTRIES}), t AS (SELECT *, row_number() OVER (PARTITION BY fonte, id ORDER BY page, pos, concat(id, '}}')) AS k FROM e WHERE page = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY fonte ORDER BY page, pos, concat(id, '}}')) AS n FROM t WHERE k = 1)
    SELECT fonte, CAST(n AS INTEGER) AS n, id FROM r WHERE n <= 20"""
)
def limited_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 rows of each source: of its pages only the first can be needed, and no other is read."""
    rows, _ = scan.search(_pages_of(spark, sf_dir, "msys", limite=20), "msys", limit=20)
    place = Window.partitionBy("fonte").orderBy("page", "pos")
    return rows.select("fonte", F.row_number().over(place).cast("int").alias("n"), "id")


_WAY = "CASE l_partkey % 5 WHEN 0 THEN 'apartamentos-para-alugar' WHEN 1 THEN 'kitnet-para-alugar' WHEN 2 THEN 'casas-para-alugar' WHEN 3 THEN 'casas-em-condominio-para-alugar' ELSE 'coberturas-para-alugar' END"
_WAY_TOTAL = "CASE WHEN caminho = 'kitnet-para-alugar' THEN 20 WHEN caminho = 'casas-para-alugar' AND fonte = 'f0' THEN NULL ELSE 90 END"


@query(
    f"""WITH e AS (SELECT concat('f', l_suppkey % 20) AS fonte, {_WAY} AS caminho, l_linenumber AS page, concat('', l_partkey % 300) AS id, floor(l_extendedprice / 20) AS aluguel, l_orderkey AS pos FROM lineitem WHERE l_partkey % 5 < 3),
    p AS (SELECT fonte, caminho, {_WAY_TOTAL} AS total, max(page) AS ate FROM e WHERE page <= 5 GROUP BY 1, 2),
    l AS (SELECT fonte, caminho, total, CASE WHEN total IS NULL THEN 1 WHEN total = 20 THEN 2 ELSE 5 END AS ultima FROM p),
    k AS (SELECT e.*, row_number() OVER (PARTITION BY e.fonte, e.id ORDER BY CASE e.caminho WHEN 'apartamentos-para-alugar' THEN 1 WHEN 'kitnet-para-alugar' THEN 2 ELSE 3 END, e.page, e.pos) AS n FROM e JOIN l ON e.fonte = l.fonte AND e.caminho = l.caminho AND e.page <= l.ultima),
    f AS (SELECT fonte, CAST(count(*) AS INTEGER) AS encontrados FROM k WHERE n = 1 AND aluguel <= 2000 GROUP BY 1)
    SELECT l.fonte, CAST(sum(total) AS INTEGER) AS total, count(*) FILTER (total > 75) = 0 AS completo, string_agg(CASE WHEN total > 75 THEN concat(caminho, ' tem ', total, ' anúncios, mas só 75 podem ser lidos (5 páginas)') END, '|' ORDER BY caminho) AS avisos, coalesce(any_value(encontrados), 0) AS encontrados
    FROM l LEFT JOIN f ON l.fonte = f.fonte GROUP BY 1"""
)
def scan_aggregator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the five paths hold a wanted type, and only those are read; prices above 2000 are left out after the scan."""
    e = table(spark, sf_dir, "lineitem").selectExpr("concat('f', l_suppkey % 20) AS fonte", f"{_WAY} AS caminho", "CAST(l_linenumber AS INT) AS page", "l_orderkey AS pos", "concat('', l_partkey % 300) AS id", "floor(l_extendedprice / 20) AS aluguel")
    types = ["flat", "studio", "casa"]
    pages = _searched(spark, "chavesnamao", e, 20, _WAY_TOTAL, aluguel_max=2000.0, tipos=types)
    _, sources = scan.search(stored(pages, "pages"), "chavesnamao", city_slug="sp-botucatu", max_rent=2000.0, types=types)
    return sources.select("fonte", "total", "completo", F.nullif(F.array_join("avisos", "|"), F.lit("")).alias("avisos"), "encontrados")


@query("SELECT DISTINCT page_id, CASE WHEN page_id % 7 = 0 THEN 'ausente' WHEN page_id % 7 = 1 THEN 'bloqueado' WHEN page_id % 7 = 2 THEN 'erro' WHEN page_id % 7 = 3 THEN 'erro' ELSE 'ok' END AS estado FROM pages")
def capture_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals with and without a challenge, pages that are gone, server errors."""
    status = F.expr("CASE page_id % 7 WHEN 0 THEN 410 WHEN 1 THEN 503 WHEN 2 THEN 503 WHEN 3 THEN 500 ELSE 200 END")
    html = F.when(F.col("page_id") % 7 == 1, F.concat(F.lit("<p>CAPTCHA</p>"), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", scan.capture_status(status, html).alias("estado")).distinct()


@query("SELECT concat('', p_partkey) AS id, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN CASE WHEN p_size % 4 <> 0 THEN p_type END END, p_brand) AS descricao, CASE WHEN p_partkey % 3 <> 0 AND p_size % 2 = 0 THEN 'x' ELSE 'a' END AS fotos, p_partkey % 3 <> 0 AS detalhado FROM part")
def overlay_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three listings have a detail page, of which some fields are null or empty."""
    p = table(spark, sf_dir, "part")
    rows = merge.default_row(p.select(F.col("p_partkey").cast("string").alias("id"), F.lit("f").alias("fonte"), F.col("p_brand").alias("descricao"), F.array(F.lit("a")).alias("fotos")))
    got = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").cast("string").alias("id"), F.lit("f").alias("fonte"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).when(F.col("p_size") % 8 == 0, "").alias("descricao"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("fotos"))
    return merge.overlay(rows, got, ["fonte", "id"]).select("id", "descricao", _join("fotos"), "detalhado")
