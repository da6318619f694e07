"""One function a platform from captured pages or API documents to listing rows, and their registry.

Each takes a DataFrame with the capture and source columns ``fonte``, ``fonte_nome``, ``base`` and gives
rows of the listing schema. Everything is column expressions over Spark's regular expressions and
variants, so captures are parsed where they are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import infer_furnished, infer_guarantees, infer_pet, map_type
from ..functions.text import bind, clean_multiline, compute_total, dedupe_contacts, fix_upper_case, half_up, html_to_text, inline, make_contact, parse_brl, parse_coord, parse_int, positive_or_null, preposition, slugify, strip_accents, uniq
from ..operators.merge import default_row
from ..schema import CONTACT
from .pages import json_ld, next_data, widget_state
from .shared import once

#: Characteristic ids of the msys API (fixed values).
MSYS_IDS = {"built": 1, "total": 2, "bedrooms": 5, "suites": 6, "bathrooms": 7, "garages": 12, "furnished": 27, "usable": 95, "all_bathrooms": 176, "pet": 194, "semi": 467, "no_pet": 621}
MSYS_PAGE, KENLO_PAGE, AGGREGATOR_PAGE, AGGREGATOR_PAGES = 50, 12, 15, 5
#: How a card begins (fixed value).
KSI_CARD = '<div class="card card-imo"'
#: State names that the msys API spells out (fixed values).
STATES = {"sao paulo": "SP", "minas gerais": "MG", "parana": "PR", "rio de janeiro": "RJ"}
#: Characteristics of the msys dictionary worth a tag, and those shown by another name (fixed values).
MSYS_TAGS = "(?iu)mob[ií]l|arm[áa]rio|ar condicionado|piscina|quintal|sacada|varanda|churrasq|ed[íi]cula|elevador|portaria|port[ãa]o|academia|playground|sal[ãa]o de festas|interfone|aquecedor|aquecimento|lareira|jardim|[áa]rea de servi[çc]o|lavanderia|despensa|escrit[óo]rio|closet|pet|seguran[çc]a|c[âa]mera|cerca|gourmet|vista|andar alto|t[ée]rrea|sobrado"
MSYS_RENAMED = {"Mobília": "Mobiliado", "Semi mobiliado": "Semimobiliado", "Lavanderias": "Lavanderia"}
#: Guarantee and amenity codes of the kenlo state (fixed values).
KENLO_GUARANTEES = {
    "GUARANTOR": "Fiador",
    "BOND_INSURANCE": "Seguro-fiança",
    "DEPOSIT": "Caução",
    "SECURITY_DEPOSIT": "Caução",
    "CAPITALIZATION": "Título de capitalização",
    "CAPITALIZATION_BOND": "Título de capitalização",
    "CREDIT_CARD": "Cartão de crédito",
    "NO_GUARANTOR": "Sem fiador",
    "WITHOUT_GUARANTOR": "Sem fiador",
}
KENLO_AMENITIES = {
    "FURNISHED": "Mobiliado",
    "SEMI_FURNISHED": "Semimobiliado",
    "PET_FRIENDLY": "Aceita pet",
    "POOL": "Piscina",
    "BARBECUE_GRILL": "Churrasqueira",
    "GOURMET_BALCONY": "Varanda gourmet",
    "BALCONY": "Sacada",
    "AIR_CONDITIONING": "Ar condicionado",
    "ELEVATOR": "Elevador",
    "GYM": "Academia",
    "PLAYGROUND": "Playground",
    "PARTY_ROOM": "Salão de festas",
    "ELECTRIC_GATE": "Portão eletrônico",
    "CONCIERGE_24H": "Portaria 24h",
    "SECURITY_24_HOURS": "Segurança 24h",
    "BACKYARD": "Quintal",
    "GARDEN": "Jardim",
    "LAUNDRY_ROOM_BR": "Lavanderia",
    "SERVICE_AREA": "Área de serviço",
    "BUILTIN_WARDROBE": "Armários embutidos",
    "KITCHEN_CABINETS": "Armários na cozinha",
    "CLOSET": "Closet",
    "INTERCOM": "Interfone",
}


def has_id(ids: Column, n: int) -> Column:
    """Membership in a |1||2| list; null is no."""
    return F.coalesce(F.contains(ids, F.lit(f"|{n}|")), F.lit(False))


def _v(doc: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(doc), f"$.{path}", kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _contacts(c: Column) -> Column:
    return F.coalesce(dedupe_contacts(c).cast(f"array<{CONTACT}>"), _no(CONTACT))


def variant_number(v: Column | str, path: str) -> Column:
    """A number of a variant: JSON numbers as they are, text by the notation of money."""
    raw = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(raw).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(v, path, "double")).otherwise(parse_brl(F.try_variant_get(v, path, "string")))


def msys_contacts(info: Column, name: Column, ddd: str | None = None) -> Column:
    """The agency's contacts in a site's imobInfo (variant); a phone may hold several numbers."""
    s = lambda v, p: F.try_variant_get(v, p, "string")
    text = lambda v, p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", s(v, p))
    email = text(info, "$.email")
    whats = F.transform(F.coalesce(F.try_variant_get(info, "$.whatsapp", "array<variant>"), F.array(info)), lambda w: F.coalesce(text(w, "$.number"), text(w, "$.whatsapp")))
    whats = F.filter(whats, lambda w: w.isNotNull())
    phones = F.flatten(F.transform(F.filter(F.array(text(info, "$.phone"), text(info, "$.phone2")), lambda p: F.trim(p) != ""), lambda p: F.split(p, "[|/;]| e ")))
    out = F.concat(F.transform(whats, lambda w: make_contact("imobiliaria", name, w, whatsapp=w, email=email, ddd=ddd)), F.transform(phones, lambda p: make_contact("imobiliaria", name, p, email=email, ddd=ddd)))
    bare = F.array(make_contact("imobiliaria", name, F.lit(None).cast("string"), email=email))
    return _contacts(bind(out, lambda some: F.when(F.size(some) > 0, some).otherwise(bare)))


def msys_names(template: Column) -> Column:
    """The site's dictionary of characteristics: array of (id, nome)."""
    return F.transform(_list(template, "$.requests.allCharacteristics"), lambda c: F.struct(F.try_variant_get(c, "$.idtCharacteristics", "int").alias("id"), F.trim(F.try_variant_get(c, "$.desCharacteristics", "string")).alias("nome")))


def _template(html: Column) -> Column:
    return F.try_variant_get(next_data(html), "$.props.initialProps.pageProps.template", "variant")


def msys_site(pages: DataFrame) -> DataFrame:
    """Captured city pages (column ``html``, one a source) to (fonte, imob, site_contatos, site_nomes), as ``msys`` takes them."""
    t = once(pages.select("fonte", "fonte_nome", _template(F.col("html")).alias("t")))
    return t.select("fonte", F.try_variant_get("t", "$.imob", "string").alias("imob"), msys_contacts(F.try_variant_get("t", "$.imobInfo", "variant"), F.col("fonte_nome")).alias("site_contatos"), msys_names(F.col("t")).alias("site_nomes"))


def _named(names: Column, id_: Column) -> Column:
    return F.try_element_at(F.transform(F.filter(names, lambda x: (x["id"] == id_) & x["nome"].isNotNull()), lambda x: x["nome"]), F.lit(-1))


def _tags(names: Column) -> Column:
    """Of names of characteristics those worth a tag, as shown."""
    table = F.create_map(*[F.lit(x) for kv in MSYS_RENAMED.items() for x in kv])
    return F.transform(F.filter(names, lambda n: n.rlike(MSYS_TAGS)), lambda n: F.coalesce(F.try_element_at(table, n), n))


def _finished(tags: Column) -> Column:
    """Distinct tags; half furnished takes the place of furnished."""
    out = uniq(tags)
    return F.when(F.array_contains(out, "Semimobiliado"), F.array_remove(out, "Mobiliado")).otherwise(out)


def msys(docs: DataFrame, site: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """API documents (column ``doc``: variant) to listings; contacts and tags need the ``msys_site`` of their sources.

    Columns named in ``keep`` stay, as they do in the other parsers.
    """
    return _msys(docs.join(site, "fonte", "left") if site is not None else docs, keep)


def msys_docs(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """API answers (column ``html``) to documents (``doc``: variant, ``pos``), as ``msys`` takes them."""
    docs = F.try_variant_get(F.try_parse_json("html"), "$.response.docs", "array<variant>")
    answers = once(pages.select("fonte", "fonte_nome", "base", *keep, docs.alias("docs")))
    return answers.select("fonte", "fonte_nome", "base", *keep, F.posexplode("docs").alias("pos", "doc")).where(_v("doc", "idtProperty").isNotNull())


def msys_place(template: Column, city: Column) -> Column:
    """Id of a city at a site (variant): of the place of that name, else the first of the site's list if it has places."""
    places = _list(template, "$.data.initialPlaces")
    name = lambda p: slugify(F.coalesce(F.try_variant_get(p, "$.city.namCity", "string"), F.lit("")))
    own = F.try_variant_get(F.get(F.filter(places, lambda p: name(p) == slugify(city)), F.lit(0)), "$.city.idtCity", "int")
    return F.coalesce(own, F.when(F.size(places) > 0, F.try_variant_get(template, "$.data.initialData.idtCityList[0]", "int")))


def msys_detail(pages: DataFrame, ddd: str | None = None) -> DataFrame:
    """Detail pages (column ``html``) to listings with brokers and characteristics; pages without a property give none."""
    t = once(pages.select("fonte", "fonte_nome", "base", _template(F.col("html")).alias("t")).withColumn("doc", F.try_variant_get("t", "$.data.property", "variant"))).where("doc IS NOT NULL AND NOT is_variant_null(doc)")
    t = t.withColumns({"site_contatos": msys_contacts(F.try_variant_get("t", "$.imobInfo", "variant"), F.col("fonte_nome"), ddd), "site_nomes": msys_names(F.col("t"))})
    s = lambda v, p: F.try_variant_get(v, p, "string")
    own = F.concat(*[_list(F.try_parse_json(s(F.col("doc"), f"$.{f}")), "$") for f in ("jsonCharacteristics", "jsonCondominiumCharacteristics")])
    said = F.filter(own, lambda c: ~F.trim(F.coalesce(s(c, "$.desInformationFormatted"), s(c, "$.desInformation"), F.lit(""))).rlike("(?iu)^(0|0,00|n[ãa]o)$"))
    names = F.transform(said, lambda c: F.coalesce(s(c, "$.characteristics.desCharacteristics"), _named(F.col("site_nomes"), F.try_variant_get(c, "$.characteristics.idtCharacteristics", "int"))))
    let = lambda c: F.coalesce(~s(c, "$.isCaptivatorLocation").isin("false", "0", ""), F.lit(False))
    all_ = _list(F.col("t"), "$.data.captivators")
    first = F.concat(F.filter(all_, let), F.filter(all_, lambda c: ~let(c)))
    brokers = F.transform(first, lambda c: make_contact("corretor", s(c, "$.namPerson"), s(c, "$.desPhone"), email=s(c, "$.desEmail"), creci=s(c, "$.creci"), ddd=ddd))
    origin = F.coalesce(F.regexp_replace(s(F.col("t"), "$.fullUrl"), "^(https?://[^/]+).*$", "$1"), F.col("base"))
    return _msys(t.withColumns({"extra": _tags(names), "corretores": brokers, "base": origin, "detalhado": F.lit(True)}))


def _msys(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    have = lambda name, none: F.coalesce(F.col(name), none) if name in docs.columns else none
    s = lambda p: _v("doc", p)
    char = lambda k: s(f"prop_char_{MSYS_IDS[k]}")
    ids = s("idtsCharacteristics")
    yes = lambda p: F.coalesce(s(p).isin("1", "true"), F.lit(False))
    text = clean_multiline(s("desInformationSite"))
    area_name = fix_upper_case(s("namDistrict"))
    sub = F.when(~s("namSubCategory").rlike("(?i)^padr[ãa]o$"), F.concat(F.lit(" "), F.lower(s("namSubCategory"))))
    made = F.concat(F.regexp_replace(F.coalesce(s("namCategory"), F.lit("Imóvel")), "(?i)s$", ""), F.coalesce(sub, F.lit("")), F.coalesce(F.concat(F.lit(" "), preposition(area_name), F.lit(" "), area_name), F.lit("")))
    title = F.coalesce(inline(s("desTitleSite")), made)
    seg = F.when(s("indType") == "SL", "venda-e-locacao").otherwise("locacao")
    where = F.concat_ws("-", slugify(F.nullif(s("namDistrict"), F.lit(""))), slugify(F.nullif(s("namCondominium"), F.lit(""))))
    url = F.concat_ws("/", "base", F.lit("imovel"), seg, slugify(F.coalesce(s("namCategory"), F.lit("imovel"))), slugify(F.coalesce(s("namCity"), F.lit(""))), F.when(where == "", "bairro").otherwise(where), s("idtProperty"))
    photos = F.from_json(s("jsonPhotos"), "array<struct<urlPhoto:string,flgNotShowSite:string>>")
    shown = F.filter(photos, lambda p: ~F.coalesce(p["flgNotShowSite"].isin("1", "true"), F.lit(False)))
    on_map = yes("flgShowMapSite")
    tags = _tags(F.transform(F.coalesce(F.regexp_extract_all(ids, F.lit(r"\|(\d+)\|"), F.lit(1)), _no("string")), lambda i: _named(have("site_nomes", _no("struct<id:int,nome:string>")), i.cast("int"))))
    held = yes("flgReservedLocation") | yes("flgPendingLocation")
    rows = docs.select(
        s("idtProperty").alias("id"), "fonte", F.lit("msys").alias("plataforma"), F.col("fonte_nome").alias("anunciante"), url.alias("url"), title.alias("titulo"),
        map_type(s("namCategory"), s("namSubCategory")).alias("tipo"), inline(F.concat_ws(" · ", F.nullif(s("namCategory"), F.lit("")), F.nullif(s("namSubCategory"), F.lit("")))).alias("subtipo"),
        F.when(~yes("flgHideValLocationSite"), positive_or_null(s("valLocation"))).alias("aluguel"), positive_or_null(F.coalesce(s("valCondominiumCalculated"), s("valCondominium"))).alias("condominio"), positive_or_null(F.coalesce(s("valIptuCalculated"), s("valMonthIptu"))).alias("iptu"),
        parse_int(F.coalesce(char("bedrooms"), s("totalRooms"))).alias("quartos"), parse_int(char("suites")).alias("suites"), parse_int(F.coalesce(char("all_bathrooms"), char("bathrooms"))).alias("banheiros"), parse_int(F.coalesce(s("totalGarages"), char("garages"))).alias("vagas"),
        parse_brl(F.coalesce(char("usable"), char("built"), char("total"))).alias("area"), area_name.alias("bairro"), fix_upper_case(s("namStreet")).alias("endereco"), fix_upper_case(s("namCity")).alias("cidade"),
        F.try_element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), F.lower(strip_accents(s("namState")))).alias("uf"),
        F.when(on_map, parse_coord(s("latitude"))).alias("lat"), F.when(on_map, parse_coord(s("longitude"))).alias("lng"), uniq(F.transform(shown, lambda p: p["urlPhoto"])).alias("fotos"), text.alias("descricao"),
        _finished(F.concat(F.when(held, F.array(F.lit("Reservado / em negociação"))).otherwise(_no("string")), tags, have("extra", _no("string")))).alias("caracteristicas"),
        F.when(has_id(ids, MSYS_IDS["furnished"]) | has_id(ids, MSYS_IDS["semi"]), True).otherwise(infer_furnished(title, text)).alias("mobiliado"),
        F.when(has_id(ids, MSYS_IDS["no_pet"]), False).when(has_id(ids, MSYS_IDS["pet"]), True).otherwise(infer_pet(text)).alias("aceita_pet"),
        infer_guarantees(text).alias("garantias"), s("idtProperty").alias("referencia"), s("dtaInsert").alias("publicado_em"), s("dtaUpdate").alias("atualizado_em"),
        _contacts(F.concat(have("corretores", _no(CONTACT)), have("site_contatos", _no(CONTACT)))).alias("contatos"), have("detalhado", F.lit(False)).alias("detalhado"), *keep,
    )
    return default_row(rows.withColumn("total", compute_total(F.col("aluguel"), F.col("condominio"), F.col("iptu"))), keep=keep)


def ksi_total(html: Column) -> Column:
    """Listings that a result page announces in its title."""
    title = F.regexp_extract(html, "(?i)<title[^>]*>([^<]*)", 1)
    return F.regexp_replace(F.regexp_extract(title, r"(?i)(\d[\d.]*)\s+im(?:[oó]|&oacute;)ve(?:is|l)\b", 1), r"\.", "").try_cast("int")


def ksi_phones(html: Column) -> Column:
    return uniq(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']tel:([+\d()\s-]{8,})[\"']"), F.lit(1)))


def ksi(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """List pages (column ``html``): one row a card, with the first two of its page's agency phones; ``pos`` can be kept."""
    agency = _contacts(F.transform(F.slice(ksi_phones(F.col("html")), 1, 2), lambda p: make_contact("imobiliaria", F.col("fonte_nome"), p)))
    from_page = [c for c in keep if c != "pos"]
    parts = F.split("html", KSI_CARD)
    cut = once(pages.select("fonte", "fonte_nome", "base", *from_page, agency.alias("contatos"), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(0))).alias("cards")))
    cards = cut.select("fonte", "fonte_nome", "base", *from_page, "contatos", F.posexplode("cards").alias("pos", "card"))
    x = lambda p, g=1: F.nullif(F.regexp_extract("card", p, g), F.lit(""))
    count = lambda p: half_up(parse_brl(x(p))).cast("int")
    cards = once(cards.withColumns({"href": x(r'href="((?:/)?alugar/[^"]+?/\d+)"'), "code": x(r"(?i)C(?:&oacute;|ó)d\.\s*<strong>\s*([\w-]+)\s*</strong>"), "place": inline(html_to_text(x(r'(?s)card-bairro-cidade-texto">(.*?)</div>'))), "texto": html_to_text(x(r'(?s)<div class="card-texto">\s*<p>(.*?)</p>'))}))
    segs = F.split(F.regexp_replace("href", "^/", ""), "/")
    seg = lambda i: F.regexp_replace(F.get(segs, F.lit(i)), "-+", " ")
    id_ = F.coalesce("code", F.regexp_extract("href", r"/(\d+)$", 1))
    title = F.coalesce(inline(x(r'<h2[^>]*title="([^"]*)"')), F.concat(F.lit("Imóvel "), id_))
    values = F.coalesce(x(r'(?s)<div class="card-valores">(.*?)</div>\s*</div>'), F.lit(""))
    price = F.coalesce(F.nullif(F.regexp_extract(values, r"R\$\s*([\d.,]+)\s*L", 1), F.lit("")), F.nullif(F.regexp_extract(values, r"R\$\s*([\d.,]+)(?![\d.,])\s*(?![LV\s\d.,])", 1), F.lit("")))
    city = F.substring_index("place", " - ", -1)
    rows = cards.where("href IS NOT NULL").select(
        id_.alias("id"), "fonte", F.lit("ksi").alias("plataforma"), F.col("fonte_nome").alias("anunciante"), F.concat_ws("/", "base", F.regexp_replace("href", "^/", "")).alias("url"), title.alias("titulo"),
        map_type(F.coalesce(seg(2), title), seg(3)).alias("tipo"), fix_upper_case(seg(3)).alias("subtipo"), parse_brl(price).alias("aluguel"), parse_brl(price).alias("total"),
        count(r'(?i)title="(\d+)\s+Dormit').alias("quartos"), count(r'(?i)title="(\d+)\s+Su(?:&iacute;|í|i)te').alias("suites"), count(r'(?i)title="(\d+)\s+Banh').alias("banheiros"), count(r'(?i)title="(\d+)\s+(?:Vaga|Garag)').alias("vagas"), parse_brl(x(r'(?i)title="([\d.,]+)\s*M(?:&sup2;|²|2)"')).alias("area"),
        fix_upper_case(F.when(F.contains("place", F.lit(" - ")), F.expr("substring(place, 1, length(place) - length(substring_index(place, ' - ', -1)) - 3)"))).alias("bairro"), fix_upper_case(F.trim(F.regexp_replace(city, "/[A-Z]{2}$", ""))).alias("cidade"), F.nullif(F.regexp_extract(city, "/([A-Z]{2})$", 1), F.lit("")).alias("uf"),
        uniq(F.transform(F.regexp_extract_all("card", F.lit('data-flickity-lazyload-src="([^"]+)"'), F.lit(1)), lambda u: F.replace(u, F.lit("/foto_thumb/"), F.lit("/foto_/")))).alias("fotos"), F.col("texto").alias("descricao"),
        infer_furnished(seg(3), F.col("texto")).alias("mobiliado"), infer_pet(F.col("texto")).alias("aceita_pet"), infer_guarantees(F.col("texto")).alias("garantias"), id_.alias("referencia"), "contatos", *keep,
    )
    return default_row(rows, keep=keep)


def offer_list(html: Column) -> Column:
    """The page's JSON-LD list of offers, a variant, or null."""
    return F.get(F.filter(json_ld(html), lambda v: (F.try_variant_get(v, '$["@type"]', "string") == "RealEstateListing") & F.try_variant_get(v, "$.offers.itemListElement", "array<variant>").isNotNull()), F.lit(0))


def aggregator_total(html: Column) -> Column:
    """Offers that a list page announces."""
    return F.try_variant_get(offer_list(html), "$.offers.numberOfItems", "int")


def aggregator(pages: DataFrame, city_slug: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """List pages of the aggregator (column ``html``): offers of the page's JSON-LD that are rentals in the city."""
    from_page = [c for c in keep if c != "pos"]
    lists = once(pages.select("fonte", *from_page, F.try_variant_get(offer_list(F.col("html")), "$.offers.itemListElement", "array<variant>").alias("offers")))
    offers = lists.select("fonte", *from_page, F.posexplode("offers").alias("pos", "o"))
    s = lambda p: _v("o", p)
    url = F.coalesce(s("url"), s('itemOffered["@id"]'))
    offers = offers.withColumn("link", url).where(F.contains("link", F.lit("-para-alugar-")) & F.contains("link", F.lit(f"-{city_slug}-")) & F.col("link").rlike(r"/id-\d+"))
    id_ = F.regexp_extract("link", r"/id-(\d+)", 1)
    area = parse_brl(F.coalesce(s("itemOffered.floorSize.value"), s("itemOffered.floorSize.unitText")))
    region = F.split(s("itemOffered.address.addressRegion"), ",")
    rows = offers.select(
        id_.alias("id"), "fonte", F.lit("chavesnamao").alias("plataforma"), fix_upper_case(inline(s("offeredBy.name"))).alias("anunciante"), F.col("link").alias("url"), F.coalesce(inline(s("name")), F.concat(F.lit("Anúncio "), id_)).alias("titulo"),
        map_type(F.replace(F.regexp_extract("link", "/imovel/([a-z-]+?)-para-alugar-", 1), F.lit("-"), F.lit(" "))).alias("tipo"), parse_brl(s("price")).alias("aluguel"), parse_brl(s("price")).alias("total"),
        parse_int(s("itemOffered.numberOfBedrooms")).alias("quartos"), parse_int(s("itemOffered.numberOfBathroomsTotal")).alias("banheiros"), F.when(~F.contains("link", F.lit("com-garagem")), 0).alias("vagas"), F.when(area > 1, area).alias("area"),
        fix_upper_case(s("itemOffered.address.addressLocality")).alias("bairro"), F.nullif(F.trim(F.get(region, F.lit(0))), F.lit("")).alias("cidade"), F.nullif(F.trim(F.get(region, F.lit(1))), F.lit("")).alias("uf"),
        uniq(F.coalesce(F.try_variant_get("o", "$.itemOffered.image", "array<string>"), F.array(s("itemOffered.image")))).alias("fotos"), *keep,
    )
    return default_row(rows, keep=keep)


def kenlo_contacts(state: Column, name: Column) -> Column:
    """The agency's contacts in a page's state: its chat number, and its offices' phones that are shown."""
    s = lambda v, p: F.try_variant_get(v, p, "string")
    chat = F.filter(F.array(s(state, "$.website.chat_whatsapp_phone")), lambda c: F.trim(c) != "")
    phones = F.flatten(F.transform(_list(state, "$.offices"), lambda o: _list(o, "$.phones")))
    phones = F.filter(phones, lambda p: (s(p, "$.number") != "") & (F.coalesce(s(p, "$.show"), F.lit("")) != "false"))
    is_wa = lambda p: F.coalesce(~s(p, "$.whatsapp").isin("", "0", "false"), F.lit(False))
    return _contacts(F.concat(F.transform(chat, lambda c: make_contact("imobiliaria", name, c, whatsapp=c)), F.transform(phones, lambda p: make_contact("imobiliaria", name, s(p, "$.number"), explicit=is_wa(p)))))


def kenlo_total(html: Column) -> Column:
    """Listings that a result page announces; null where the page has no state."""
    return F.try_variant_get(widget_state(html, "listings"), "$.settings.listings.count", "int")


def kenlo(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """List pages (column ``html``): rows of the page's embedded state, with the agency's contacts."""
    from_page = [c for c in keep if c != "pos"]
    state = pages.select("fonte", "fonte_nome", "base", *from_page, widget_state(F.col("html"), "listings").alias("state"))
    data = F.try_variant_get("state", "$.settings.listings.data", "array<variant>")
    read = once(state.select("fonte", "fonte_nome", "base", *from_page, kenlo_contacts(F.col("state"), F.col("fonte_nome")).alias("contatos"), data.alias("data")))
    d = read.select("fonte", "fonte_nome", "base", *from_page, "contatos", F.posexplode("data").alias("pos", "d"))
    return _kenlo(d, keep)


def kenlo_detail(pages: DataFrame) -> DataFrame:
    """Detail pages (column ``html``) to listings with brokers, fees and place; pages without a listing give none."""
    state = once(pages.select("fonte", "fonte_nome", "base", widget_state(F.col("html"), "listing-details").alias("state")).withColumn("d", F.try_variant_get("state", "$.settings.listing[0]", "variant"))).where("d IS NOT NULL")
    s = lambda v, p: F.try_variant_get(v, p, "string")
    agency = kenlo_contacts(F.col("state"), F.col("fonte_nome"))
    whats = lambda b: F.coalesce(s(b, "$.broker_whatsapp") != "false", F.lit(True))

    def broker(b: Column) -> Column:
        of = lambda phone, **kw: make_contact("corretor", s(b, "$.broker_name"), phone, email=s(b, "$.broker_email"), creci=s(b, "$.broker_credential"), **kw)
        mobile, phone = F.nullif(s(b, "$.broker_mobile_phone"), F.lit("")), F.nullif(s(b, "$.broker_phone"), F.lit(""))
        some = F.array_compact(F.array(F.when(mobile.isNotNull(), of(mobile, explicit=whats(b))), F.when(phone.isNotNull(), of(phone))))
        return F.when(F.size(some) > 0, some).otherwise(F.array(of(F.lit(None).cast("string"))))

    origin = F.regexp_replace(F.coalesce(s("state", "$.server.full_url"), F.col("base")), "^(https?://[^/]+).*$", "$1")
    at = lambda *paths: parse_coord(F.coalesce(*[s("d", f"$.{p}") for p in paths]))
    t = state.withColumns({"contatos": _contacts(F.concat(F.flatten(F.transform(_list(F.col("d"), "$.brokers"), broker)), agency)), "base": origin, "condominio": positive_or_null(s("d", "$.condo_fees")), "iptu": positive_or_null(s("d", "$.property_tax")), "lat": at("lat", "latitude", "location.lat"), "lng": at("lng", "lon", "longitude", "location.lon", "location.lng"), "detalhado": F.lit(True)})
    rows = _kenlo(t, ("_condo", "_tax", "_lat", "_lng"), {"_condo": F.col("condominio"), "_tax": F.col("iptu"), "_lat": F.col("lat"), "_lng": F.col("lng")})
    names = [c for c in rows.columns if not c.startswith("_")]
    full = {"condominio": F.col("_condo"), "iptu": F.col("_tax"), "total": compute_total(F.col("aluguel"), F.col("_condo"), F.col("_tax")), "lat": F.col("_lat"), "lng": F.col("_lng"), "detalhado": F.lit(True)}
    return rows.select(*[full[c].alias(c) if c in full else F.col(c) for c in names])


def _kenlo(d: DataFrame, keep: tuple[str, ...], also: dict[str, Column] | None = None) -> DataFrame:
    """Rows of a state (column ``d``: variant; ``contatos``) to listings."""
    d = d.withColumns(also) if also else d
    s = lambda p: _v("d", p)
    first = lambda p: F.coalesce(_v("d", f"{p}[0]"), s(p))
    amen = F.coalesce(F.try_variant_get("d", "$.amenities", "array<string>"), F.array().cast("array<string>"))
    named = lambda codes, table: F.transform(codes, lambda a: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), a))
    text = clean_multiline(s("listing_description"))
    id_, rent, all_in = s("property_full_reference"), parse_brl(first("rent_price")), parse_brl(s("total_rent"))
    photos = F.transform(F.coalesce(F.try_variant_get("d", "$.photos", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.coalesce(F.try_variant_get(p, "$.picture_full", "string"), F.try_variant_get(p, "$.picture_full_fallback", "string")))
    codes = F.coalesce(F.try_variant_get("d", "$.rent_guarantee", "array<string>"), F.array().cast("array<string>"))
    rows = d.where(id_.isNotNull()).select(
        id_.alias("id"), "fonte", F.lit("kenlo").alias("plataforma"), F.col("fonte_nome").alias("anunciante"), F.when(s("url").startswith("http"), s("url")).otherwise(F.concat("base", F.coalesce(s("url"), F.lit("")))).alias("url"), F.coalesce(inline(F.coalesce(s("website_title"), s("heading1"), s("about_title"))), F.concat(F.lit("Imóvel "), id_)).alias("titulo"),
        map_type(s("property_type")).alias("tipo"), inline(s("type")).alias("subtipo"), rent.alias("aluguel"), F.when(all_in >= rent, all_in).otherwise(rent).alias("total"),
        parse_int(first("bedrooms")).alias("quartos"), parse_int(first("suites")).alias("suites"), parse_int(first("bathrooms")).alias("banheiros"), parse_int(first("garages")).alias("vagas"), parse_brl(first("area")).alias("area"),
        fix_upper_case(inline(F.coalesce(s("neighborhood_display"), s("neighborhood")))).alias("bairro"), inline(s("city")).alias("cidade"), inline(s("state")).alias("uf"), uniq(photos).alias("fotos"), text.alias("descricao"), uniq(named(amen, KENLO_AMENITIES)).alias("caracteristicas"),
        F.when(F.arrays_overlap(amen, F.array(F.lit("FURNISHED"), F.lit("SEMI_FURNISHED"))), True).otherwise(infer_furnished(text)).alias("mobiliado"), F.when(F.array_contains(amen, "PET_FRIENDLY"), True).otherwise(infer_pet(text)).alias("aceita_pet"),
        uniq(F.concat(named(codes, KENLO_GUARANTEES), infer_guarantees(text))).alias("garantias"), F.coalesce(s("property_reference"), F.regexp_replace(id_, "-[A-Z0-9]+$", "")).alias("referencia"), s("updated_at").alias("atualizado_em"), "contatos", *keep,
    )
    return default_row(rows, keep=keep)


REGISTRY: dict[str, Callable[..., DataFrame]] = {"msys": msys, "ksi": ksi, "chavesnamao": aggregator, "kenlo": kenlo}


def platform(name: str) -> Callable[..., DataFrame]:
    """The list parser of a platform; ``details.detail`` has its detail parser."""
    if name not in REGISTRY:
        raise ValueError(f"unknown platform {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name]
