"""Detail pages of the platforms whose list pages leave fields out, and the registry of detail parsers.

Each takes captures (``fonte``, ``fonte_nome``, ``base``, the listing's ``id``, ``html``) and gives one row a
page with the listing's key and the fields that a detail page has, null where it does not say.
``merge.overlay`` lays them over the list's rows. A page's text is cut into lines once; labels are
looked for in the array of lines, so no page is spread over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import infer_furnished, infer_guarantees, infer_pet
from ..functions.text import WS, bind, clean_multiline, compute_total, decode_entities, fix_upper_case, html_to_text, inline, make_contact, parse_brl, parse_coord, parse_int, uniq
from ..schema import CONTACT
from .pages import json_ld, payload_count, payload_field
from .platforms import _contacts, _list, kenlo_detail, ksi_phones, msys_detail, variant_number

#: Labels of ksi detail pages (fixed values).
RENT, CONDO, TAX, TOTAL = "(?iu)^Aluguel$", "(?iu)^Condom[ií]nio$", "(?iu)^IPTU$", r"(?iu)^Total\s*/\s*M[eê]s$"
ITEMS, BUILDING = "(?iu)^Itens do Im[oó]vel$", "(?iu)^Itens do Edif[ií]cio"
ENDS = "^Conhe[çc]a |^Localiza[çc][ãa]o|^DISPON|^Fale com"
HEADINGS = "(?iu)^(Seguran[çc]a|Utilit[áa]rios|Lazer|Servi[çc]os)$"
BROKER = "(?iu)^CORRETOR RESPONS[ÁA]VEL$"
STATUS = "(?iu)^(DISPON[IÍ]VEL|ALUGADO|RESERVADO|LOCADO|EM NEGOCIA[ÇC][ÃA]O)$"
#: Characters of the longest feature shown, and lines looked at after a section's start.
FEATURE, SECTION = 60, 59


def text_lines(html: Column) -> Column:
    """Every text node of a page as a line, blanks squeezed, empty ones left out."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|svg).*?</\1>", "\n"), "<[^>]+>", "\n")
    trimmed = F.transform(F.split(decode_entities(bare), "\n"), lambda x: F.trim(F.regexp_replace(x, f"{WS}+", " ")))
    return F.filter(trimmed, lambda x: x != "")


def _rest(lines: Column) -> Column:
    return F.slice(lines, 2, F.greatest(F.size(lines), F.lit(0)))


def value_after(lines: Column, label: str) -> Column:
    """The first number that stands in the line after a label."""
    found = F.zip_with(lines, _rest(lines), lambda a, b: F.when(a.rlike(label) & b.rlike(r"^\d[\d.,]*$"), b))
    return parse_brl(F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))


def value_before(lines: Column, label: str) -> Column:
    """The first number that stands in the line before a label."""
    found = F.zip_with(lines, _rest(lines), lambda a, b: F.when(b.rlike(label), parse_brl(a)))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def _place(lines: Column, pattern: str) -> Column:
    """Place of the first line that matches, from 1; 0 for none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True), F.lit(0)).cast("int")


def section_items(lines: Column, start: str, stop: str) -> Column:
    """The lines between the first that matches ``start`` and the next that matches ``stop``, 59 at most."""
    body = bind(_place(lines, start), lambda i: F.when(i > 0, F.slice(lines, i + 1, F.lit(SECTION))).otherwise(F.array().cast("array<string>")))
    return bind(body, lambda b: bind(_place(b, stop), lambda e: F.when(e > 0, F.slice(b, F.lit(1), F.greatest(e - 1, F.lit(0)))).otherwise(b)))


def _typed(html: Column, kind: str, field: str | None = None) -> Column:
    """The first JSON-LD item of a type (that has a field)."""
    is_it = lambda v: (F.try_variant_get(v, '$["@type"]', "string") == kind) & (F.try_variant_get(v, f"$.{field}", "variant").isNotNull() if field else F.lit(True))
    return F.get(F.filter(json_ld(html), is_it), F.lit(0))


def _images(v: Column | str, path: str) -> Column:
    return uniq(F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array(F.try_variant_get(v, path, "string"))))


def _positive(c: Column) -> Column:
    return bind(c, lambda n: F.when(n > 0, n))


def ksi_detail(pages: DataFrame) -> DataFrame:
    """Rent, fees, rooms, features and the broker from a page's labelled lines; photos and text from its JSON-LD."""
    p = pages.select("fonte", "fonte_nome", "id", "html", text_lines(F.col("html")).alias("l"), _typed(F.col("html"), "Product").alias("ld"))
    l, ld = F.col("l"), F.col("ld")
    items = section_items(l, ITEMS, f"(?iu)^Itens do |{ENDS}")
    building = F.filter(section_items(l, BUILDING, f"(?iu){ENDS}"), lambda x: ~x.rlike(HEADINGS))
    status = F.get(F.filter(l, lambda x: x.rlike(STATUS)), F.lit(0))
    p = p.withColumns({
        "itens": items, "predio": _rest(building), "status": F.when(~status.rlike("(?i)^DISPON"), F.concat(F.substring(status, 1, 1), F.lower(F.substring(status, 2, 100)))),
        "at": _place(l, BROKER), "aluguel": F.coalesce(value_after(l, RENT), variant_number(ld, "$.offers.price")), "condominio": _positive(value_after(l, CONDO)), "iptu": _positive(value_after(l, TAX)),
        "descricao": html_to_text(F.replace(F.try_variant_get(ld, "$.description", "string"), F.lit("\n"), F.lit("<br>"))),
    })
    name = F.regexp_replace(F.get(l, F.col("at")), r"(?iu)\s+-\s+(Loca[çc][ãa]o|Venda|Vendas)$", "")
    creci = F.nullif(F.regexp_extract(F.get(l, F.col("at") + 1), r"(?i)CRECI\s*([\w-]+)", 1), F.lit(""))
    null = F.lit(None).cast("string")
    broker = F.named_struct(F.lit("nome"), name, F.lit("papel"), F.lit("corretor"), F.lit("telefone"), null, F.lit("whatsapp"), null, F.lit("email"), null, F.lit("creci"), creci).cast(CONTACT)
    agency = F.transform(F.slice(ksi_phones(F.col("html")), 1, 1), lambda x: make_contact("imobiliaria", F.col("fonte_nome"), x).cast(CONTACT))
    people = F.concat(F.when((F.col("at") > 0) & (name != ""), F.array(broker)).otherwise(F.array().cast(f"array<{CONTACT}>")), agency)
    text, has = F.col("descricao"), F.col("descricao").isNotNull()
    none = F.array().cast("array<string>")
    tags = uniq(F.concat(F.when(F.col("status").isNotNull(), F.array("status")).otherwise(none), "itens", "predio"))
    return p.select(
        "fonte", "id", "aluguel", "condominio", "iptu", F.coalesce(value_after(l, TOTAL), compute_total(F.col("aluguel"), F.col("condominio"), F.col("iptu"))).alias("total"),
        *[parse_int(value_before(l, label).cast("string")).alias(c) for c, label in (("quartos", "(?iu)^Dormit[óo]rios?$"), ("suites", "(?iu)^Su[íi]tes?$"), ("banheiros", "(?iu)^Banheiros?$"), ("vagas", "(?iu)^(Garagens?|Vagas?)$"))],
        F.coalesce(value_before(l, r"(?iu)^A\.\s*[ÚU]til$"), value_before(l, r"(?iu)^A\.\s*Total$")).alias("area"), F.filter(tags, lambda x: F.length(x) <= FEATURE).alias("caracteristicas"), _contacts(people).alias("contatos"), "descricao",
        F.when(has, infer_furnished(text, F.array_join("itens", " "))).alias("mobiliado"), F.when(has, infer_pet(text)).alias("aceita_pet"), F.when(has, infer_guarantees(text)).alias("garantias"), _images(ld, "$.image").alias("fotos"), F.lit(True).alias("detalhado"),
    )


def aggregator_detail(pages: DataFrame) -> DataFrame:
    """Fields of a page's JSON-LD and of its escaped script payload; the place is the neighbourhood's centre."""
    geo = r'"neighborhood":\{"id":\d+,"name":"[^"]*","url":"[^"]*","geoposition":\{"lon":"(-?[\d.]+)","lat":"(-?[\d.]+)"'
    p = pages.select("fonte", "id", _typed(F.col("html"), "RealEstateListing", "about").alias("ld"), F.replace("html", F.lit('\\"'), F.lit('"')).alias("u"))
    u = F.col("u")
    s = lambda path: F.try_variant_get("ld", f"$.{path}", "string")
    item, agent = "about.offers.itemOffered", "about.offers.offeredBy"
    amenity = F.filter(_list(F.col("ld"), f"$.{item}.amenityFeature"), lambda a: F.coalesce(F.try_variant_get(a, "$.value", "boolean"), F.lit(True)))
    p = p.withColumns({
        "anunciante": fix_upper_case(s(f"{agent}.name")), "creci": payload_field(u, "creci"), "descricao": clean_multiline(F.coalesce(s("description"), s("about.offers.description"))), "aluguel": variant_number("ld", "$.about.offers.price"),
        "condominio": _positive(parse_brl(payload_field(u, "condominiumFee"))), "iptu": _positive(parse_brl(payload_field(u, "iptuValue"))), "whats": F.regexp_extract_all(F.regexp_extract(u, r'"whatsapp":\[((?:"[^"]*",?)*)\]', 1), F.lit('"([^"]+)"'), F.lit(1)),
        "tags": uniq(F.transform(amenity, lambda a: inline(F.try_variant_get(a, "$.name", "string")))), "has_geo": u.rlike(geo), "area_": F.coalesce(parse_brl(payload_field(u, "useful")), parse_brl(payload_field(u, "total"))),
    })
    person = lambda phone, **kw: make_contact("anunciante", F.col("anunciante"), phone, creci=F.col("creci"), **kw).cast(CONTACT)
    phone = F.filter(F.array(s(f"{agent}.telephone")), lambda x: x != "")
    people = F.concat(F.transform("whats", lambda w: person(w, whatsapp=w, explicit=F.lit(True))), F.transform(phone, lambda x: person(x)))
    at = lambda group, path: F.when(F.col("has_geo"), parse_coord(F.regexp_extract(u, geo, group))).otherwise(parse_coord(s(f"{item}.geo.{path}")))
    text = F.col("descricao")
    dated = lambda f: F.when(F.schema_of_variant(F.try_variant_get("ld", f"$.{f}", "variant")) == "STRING", s(f))
    p = p.withColumns({"lat": at(2, "latitude"), "lng": at(1, "longitude")})
    return p.select(
        "fonte", "id", "anunciante", payload_field(u, "reference").alias("referencia"), "aluguel", "condominio", "iptu", compute_total(F.col("aluguel"), F.col("condominio"), F.col("iptu")).alias("total"),
        F.coalesce(payload_count(u, "bedrooms"), parse_int(s(f"{item}.numberOfBedrooms"))).alias("quartos"), payload_count(u, "suites").alias("suites"), F.coalesce(payload_count(u, "bathrooms"), parse_int(s(f"{item}.numberOfBathroomsTotal"))).alias("banheiros"), payload_count(u, "garages").alias("vagas"),
        "descricao", F.col("tags").alias("caracteristicas"), F.when(F.exists("tags", lambda x: x.rlike("(?i)mobiliad")), True).otherwise(infer_furnished(text)).alias("mobiliado"),
        F.when(F.coalesce(payload_field(u, "petFriendly") == "true", F.lit(False)) | F.coalesce(F.try_variant_get("ld", f"$.{item}.petsAllowed", "boolean"), F.lit(False)), True).otherwise(infer_pet(text)).alias("aceita_pet"), infer_guarantees(text).alias("garantias"),
        _contacts(people).alias("contatos"), dated("datePosted").alias("publicado_em"), dated("dateModified").alias("atualizado_em"), "lat", "lng", F.col("lat").isNotNull().alias("coord_aprox"),
        _images("ld", "$.about.image").alias("fotos"), F.when(F.col("area_") > 1, F.col("area_")).alias("area"), F.lit(True).alias("detalhado"),
    )


DETAILS: dict[str, Callable[..., DataFrame]] = {"msys": msys_detail, "ksi": ksi_detail, "chavesnamao": aggregator_detail, "kenlo": kenlo_detail}


def detail(name: str) -> Callable[..., DataFrame]:
    """The detail parser of a platform."""
    if name not in DETAILS:
        raise ValueError(f"unknown platform {name!r}; known: {', '.join(DETAILS)}")
    return DETAILS[name]
