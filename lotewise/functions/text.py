"""Text, number and phone rules of listings, as column expressions."""

from __future__ import annotations

import re

import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Every precomposed Latin letter and the ASCII letter under its accents."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


_ACCENTED, _PLAIN = _plain_letters()
#: White space as browsers count it.
WS = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: Words that stay in lower case inside a name (fixed values).
_LOWER_WORDS = ("de", "da", "do", "das", "dos", "e", "em", "na", "no")
#: Named entities that pages use (fixed values); what they stand for is the HTML standard's.
_ENTITIES = (
    "amp lt gt quot apos nbsp shy aacute agrave acirc atilde auml eacute egrave ecirc euml iacute igrave icirc iuml oacute ograve ocirc otilde ouml "
    "uacute ugrave ucirc uuml ccedil ntilde Aacute Agrave Acirc Atilde Auml Eacute Egrave Ecirc Iacute Icirc Oacute Ocirc Otilde Ouml Uacute Uuml "
    "Ccedil Ntilde ordf ordm deg sup2 sup3 middot bull ndash mdash hellip trade reg copy lsquo rsquo ldquo rdquo laquo raquo euro frac12 times"
).split()
_NAMED = {n: html5[f"{n};"] for n in _ENTITIES} | {"nbsp": " ", "shy": ""}
_ENTITY = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
#: Abbreviations of neighbourhood names, in the order they are expanded (fixed values).
_ABBREVIATIONS = (
    ("jd", "jardim"),
    ("jdm", "jardim"),
    ("vl", "vila"),
    ("pq", "parque"),
    ("prq", "parque"),
    ("res", "residencial"),
    ("resid", "residencial"),
    ("conj", "conjunto"),
    ("cj", "conjunto"),
    ("ch", "chacara"),
    ("sta", "santa"),
    ("sto", "santo"),
    ("ns", "nossa senhora"),
    ("nsa", "nossa senhora"),
    ("dr", "doutor"),
)
#: Words that company names are compared without, and first words of feminine neighbourhoods (fixed values).
_COMPANY_WORDS = r"\b(ltda|me|eireli|s/?a|imoveis|imobiliaria|negocios|imobiliarios|solucoes|corretora|de|da|do|dos|das|e)\b"
_FEMININE = "vila|vl|chacara|cidade|fazenda|estancia|colonia|quinta|rua|avenida|praca|area|zona|comunidade|granja"


def _none(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is evaluated once however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[\u0300-\u036f]", "")


def plain(text: str) -> str:
    """The same of a Python string."""
    return re.sub("[\u0300-\u036f]", "", text.translate(str.maketrans(_ACCENTED, _PLAIN)))


def _meaning(name: Column) -> Column:
    """What an entity's name or number stands for; null for unknown names."""
    table = F.create_map(*[F.lit(x) for kv in _NAMED.items() for x in kv])
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 12), 16, 10)).otherwise(F.substring(name, 2, 12)).try_cast("bigint")
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(name.startswith("#"), F.when(good, letter).otherwise("")).otherwise(F.try_element_at(table, name))


def decode_entities(c: Column) -> Column:
    """HTML entities decoded in a single pass, in the JVM; unknown ones stay, impossible code points vanish."""

    def whole(t: Column) -> Column:
        names = F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(1))
        parts = F.split(t, _ENTITY, -1)
        said = lambda p, n: F.concat(p, F.when(n.isNull(), "").otherwise(F.coalesce(_meaning(n), F.concat(F.lit("&"), n, F.lit(";")))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(F.zip_with(parts, names, said), "")).otherwise(t)

    return bind(c, whole)


def html_to_text(c: Column) -> Column:
    """Readable text of HTML: line ends for breaks and blocks, dashes for list items, entities decoded."""
    t = F.regexp_replace(c, r"(?is)<(script|style).*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)<\s*br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</(p|li|div|h\d|tr|ul|ol|section|article)>", "\n")
    t = F.regexp_replace(t, r"(?i)<li[^>]*>", "- ")
    return clean_multiline(decode_entities(F.regexp_replace(t, r"<[^>]+>", " ")), decode=False)


def clean_multiline(c: Column, decode: bool = True) -> Column:
    """Blanks squeezed, lines trimmed, at most one empty line in a row; empty is null."""
    t = F.replace(decode_entities(c) if decode else c, F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, "[ \t ]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return _none(F.regexp_replace(t, f"^{WS}+|{WS}+$", ""))


def inline(c: Column) -> Column:
    """One line: entities decoded, white space squeezed, empty is null."""
    return _none(F.trim(F.regexp_replace(decode_entities(c), f"{WS}+", " ")))


def inline_plain(c: Column) -> Column:
    """``inline`` for text known to hold no entities; stays in the JVM."""
    return _none(F.trim(F.regexp_replace(c, f"{WS}+", " ")))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fix_upper_case(c: Column) -> Column:
    """Names written all in capitals get ordinary case; others are only put on one line, entities decoded."""

    def word(w: Column, i: Column) -> Column:
        return F.when((i > 0) & w.isin(*_LOWER_WORDS), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))

    def whole(t: Column) -> Column:
        shouting = (t == F.upper(t)) & t.rlike("[A-ZÀ-Ý]{3}")
        return F.when(shouting, F.array_join(F.transform(F.split(F.lower(t), " "), word), " ")).otherwise(t)

    return bind(inline(c), whole)


def preposition(c: Column) -> Column:
    """na or no, by the first word of a neighbourhood."""
    first = F.lower(strip_accents(F.get(F.split(F.trim(c), f"{WS}+"), F.lit(0))))
    return F.when(first.rlike(f"^({_FEMININE})$"), "na").otherwise("no")


def title_slug(c: Column) -> Column:
    words = F.filter(F.split(strip_accents(c), "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(w.substr(1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "-")


def normalize_bairro(c: Column) -> Column:
    """Key under which neighbourhoods compare; null gives an empty key."""
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(strip_accents(c)), "[()]", " "), F.lit(" "))
    for short, full in _ABBREVIATIONS:
        t = F.regexp_replace(t, rf"\b{short}\.?\s+", f"{full} ")
    return F.coalesce(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(""))


def normalize_name(c: Column) -> Column:
    """Key under which company names compare; null gives an empty key."""
    t = F.regexp_replace(F.lower(strip_accents(c)), _COMPANY_WORDS, " ")
    return F.coalesce(F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(""))


def norm(*parts: Column) -> Column:
    """Text in which hints are looked for: no accents, lower case, one blank at each end."""
    t = F.concat_ws(" \n ", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(strip_accents(t)), f"{WS}+", " "), F.lit(" "))


def norm_ref(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def uniq(c: Column) -> Column:
    """Trimmed, non-empty, distinct strings in their order."""
    trimmed = F.transform(c, lambda x: F.regexp_replace(x, f"^{WS}+|{WS}+$", ""))
    return F.coalesce(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), F.array().cast("array<string>"))


def parse_brl(c: Column) -> Column:
    """Money or number in Brazilian or plain notation; null where there is none."""

    def number(s: Column) -> Column:
        plain = (
            F.when(s.rlike(r",\d{1,2}$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(s.rlike(r"\.\d{3}(\.|$)") & ~s.contains(","), F.replace(s, F.lit("."), F.lit("")))
            .otherwise(F.replace(s, F.lit(","), F.lit("")))
        )
        return plain.try_cast("double")

    def whole(raw: Column) -> Column:
        first = F.regexp_replace(F.regexp_extract(raw, r"-?\d[\d.,]*", 0), "[.,]$", "")
        return F.when(~raw.rlike("(?i)undefined|consult"), bind(first, number))

    return bind(F.regexp_replace(c, rf"R\$|{WS}", ""), whole)


def parse_int(c: Column) -> Column:
    """Whole number of a string; what has no digits is 0, negative or malformed is null (JavaScript's rules)."""

    def whole(t: Column) -> Column:
        return F.when(t == "", 0.0).otherwise(t.try_cast("double"))

    n = bind(F.regexp_replace(F.nullif(c, F.lit("")), r"[^\d.-]", ""), whole)
    return bind(n, lambda x: F.when(x >= 0, F.floor(x + 0.5).try_cast("int")))


def parse_coord(c: Column) -> Column:
    return bind(c.cast("string").try_cast("double"), lambda n: F.when((n != 0) & ~F.isnan(n), n))


def positive_or_null(c: Column) -> Column:
    return bind(parse_brl(c.cast("string")), lambda n: F.when(n > 0, n))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding with halves towards plus infinity."""
    return F.floor(c * 10.0**digits + 0.5) / 10.0**digits


def compute_total(rent: Column, condo: Column, tax: Column) -> Column:
    return half_up(rent + F.coalesce(condo, F.lit(0.0)) + F.coalesce(tax, F.lit(0.0)), 2)


def plain_number(c: Column) -> Column:
    """A number in Brazilian notation with two decimals at most; null stays."""
    return F.regexp_replace(F.translate(F.format_number(half_up(c.cast("double"), 2), 2), ",.", ".,"), r",00$|(?<=,\d)0$", "")


def brl(c: Column) -> Column:
    """Amount as text, a dash for null."""
    return F.coalesce(F.concat(F.lit("R$ "), plain_number(c)), F.lit("—"))


def escape_html(c: Column) -> Column:
    t = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.coalesce(t, F.lit(""))


def fill_template(template: str, **values: Column) -> Column:
    """A message with its {placeholders} filled; null leaves nothing."""
    t = F.lit(template)
    for name, v in values.items():
        t = F.replace(t, F.lit(f"{{{name}}}"), F.coalesce(v.cast("string"), F.lit("")))
    return t


def link_text(c: Column) -> Column:
    """Percent-encoded text for a link; blanks are %20."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def parse_phone(c: Column, ddd: str | None = None) -> Column:
    """struct(exibicao, digitos, e164, celular) of a Brazilian number, or null."""

    def number(d: Column) -> Column:
        num = F.substring(d, 3, 20)
        long = F.length(num) == 9
        shown = F.concat(F.lit("("), F.substring(d, 1, 2), F.lit(") "), F.when(long, F.substring(num, 1, 5)).otherwise(F.substring(num, 1, 4)), F.lit("-"), F.when(long, F.substring(num, 6, 9)).otherwise(F.substring(num, 5, 9)))
        return F.when(F.length(d).isin(10, 11), F.named_struct(F.lit("exibicao"), shown, F.lit("digitos"), d, F.lit("e164"), F.concat(F.lit("55"), d), F.lit("celular"), long & num.startswith("9")))

    steps = [lambda d: F.when(d.startswith("55") & F.length(d).isin(12, 13), F.substring(d, 3, 20)).otherwise(d), lambda d: F.when(d.startswith("0") & F.length(d).isin(11, 12), F.substring(d, 2, 20)).otherwise(d)]
    if ddd:
        steps.append(lambda d: F.when(F.length(d).isin(8, 9), F.concat(F.lit(ddd), d)).otherwise(d))
    out = F.regexp_replace(c, r"\D", "")
    for f in [*steps, number]:
        out = bind(out, f)
    return out


def make_contact(role: str, name: Column, phone: Column, whatsapp: Column | None = None, explicit: Column | None = None, email: Column | None = None, creci: Column | None = None, ddd: str | None = None) -> Column:
    """A contact; WhatsApp is the number said to be one, else the phone if said so or a mobile."""
    null = F.lit(None).cast("string")

    def contact(tel: Column, wa: Column) -> Column:
        says = F.coalesce(explicit, tel["celular"]) if explicit is not None else tel["celular"]
        return F.named_struct(  # named so that it can be read inside a lambda
            F.lit("nome"), inline(name),
            F.lit("papel"), F.lit(role),
            F.lit("telefone"), F.coalesce(tel["exibicao"], wa["exibicao"]),
            F.lit("whatsapp"), F.coalesce(wa["e164"], F.when(says, tel["e164"])),
            F.lit("email"), _none(F.trim(email if email is not None else null)),
            F.lit("creci"), _none(F.trim(creci if creci is not None else null)),
        )

    if whatsapp is None:
        return bind(parse_phone(phone, ddd), lambda tel: contact(tel, F.lit(None).cast("struct<exibicao:string,e164:string>")))
    if whatsapp is phone:  # one number, parsed once
        return bind(parse_phone(phone, ddd), lambda tel: contact(tel, tel))
    return bind(parse_phone(phone, ddd), lambda tel: bind(parse_phone(whatsapp, ddd), lambda wa: contact(tel, wa)))


def contact_key(c: Column) -> Column:
    """What makes two contacts one: digits of the number, else the e-mail, else name and licence."""
    digits = F.coalesce(_none(F.regexp_replace(F.coalesce(c["telefone"], F.lit("")), r"\D", "")), _none(F.regexp_replace(F.coalesce(c["whatsapp"], F.lit("")), "^55", "")))
    return F.coalesce(F.concat(F.lit("t:"), digits), F.concat(F.lit("e:"), F.lower(_none(c["email"]))), F.concat_ws("|", F.lit("n:"), F.coalesce(c["nome"], F.lit("null")), F.coalesce(c["creci"], F.lit("null"))))


def dedupe_contacts(c: Column) -> Column:
    """Contacts one can reach, one of each key in order of appearance, completed from the later ones."""
    some = lambda x: x.isNotNull() & (x != "")
    reachable = lambda x: some(x["telefone"]) | some(x["whatsapp"]) | some(x["email"]) | (some(x["nome"]) & some(x["creci"]))

    def fuse(own: Column) -> Column:
        first = lambda f: F.get(F.filter(F.transform(own, lambda x: x[f]), lambda v: v.isNotNull()), F.lit(0))
        head = F.get(own, F.lit(0))
        return F.named_struct(*[y for f in ("nome", "papel", "telefone", "whatsapp", "email", "creci") for y in (F.lit(f), head[f] if f in ("papel", "telefone") else first(f))])

    def whole(keyed: Column) -> Column:
        keys = F.array_distinct(F.transform(keyed, lambda x: x["k"]))
        return F.transform(keys, lambda k: bind(F.transform(F.filter(keyed, lambda x: x["k"] == k), lambda x: x["c"]), fuse))

    return bind(F.transform(F.filter(c, reachable), lambda x: F.named_struct(F.lit("k"), contact_key(x), F.lit("c"), x)), whole)
