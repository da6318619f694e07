"""Ordered classifiers of listings: type, refinement, furniture, pets, guarantees, families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import norm, strip_accents

#: Types by the first pattern that matches (fixed values, in order).
TYPE_RULES = (
    ("kitnet", r"kit ?net|kitinete|quitinete|studio apartment"),
    ("studio", r"\bstudio\b|\bestudio\b|\bloft\b"),
    ("flat", r"\bflat\b"),
    ("cobertura", r"cobertura|penthouse"),
    ("rural", r"chacara|\bsitio\b|fazenda|rancho|\brural\b|small farm|\bfarm\b|haras"),
    ("terreno", r"terreno|\blote\b|\bland\b"),
    (
        "comercial",
        r"galpao|barracao|deposito|armazem|\bshed\b|outhouse|comercial|\bponto\b|\bloja\b|\bsala\b|salao|escritorio|consultorio|\bpredio\b|\bbuilding\b|\bbusiness\b|\bpoint\b|\broom\b|\bhall\b|hotel|pousada|clinica|industrial|garagem|estacionamento|\bbox\b|\bparking\b",
    ),
    ("casa_condominio", r"(casa|house|sobrado).*(condominio|condo)|condominio fechado|\bcondo house\b"),
    ("sobrado", r"sobrado|two story|assobradad"),
    ("casa", r"\bcasas?\b|\bhouse\b|edicula|residencia"),
    ("apartamento", r"apartamento|\baptos?\b|\bapartment\b|\bap\b|\bapto\b"),
)
#: Refinements by title: types they apply to, pattern, new type (fixed values, in order).
REFINE_RULES = (
    (("apartamento", "outro", "flat"), r"kit ?net|kitinete|quitinete", "kitnet"),
    (("apartamento", "outro", "flat"), r"\bstudio\b|\bestudio\b|\bloft\b", "studio"),
    (("apartamento", "outro", "flat"), r"\bcobertura\b", "cobertura"),
    (("casa", "outro"), r"condominio fechado|casa (em|de) condominio", "casa_condominio"),
    (("casa", "outro"), r"\bsobrado\b", "sobrado"),
    (("outro",), r"\bcasa\b", "casa"),
    (("outro",), r"apartamento|\bapto\b", "apartamento"),
)
#: Hints in running text (fixed values).
NOT_FURNISHED = r"\b(nao|sem) (e |esta |sera )?(semi ?)?mobiliad|\bvazio\b.*\bsem moveis\b"
FURNISHED = r"mobiliad[oa]s?\b|\bfurnished\b|\bcom moveis\b"
NO_PETS = r"(nao|proibid[oa]s?|vedad[oa]s?) (se )?(aceita(mos|m)?|permit\w*|sao permitidos)? ?(a )?(entrada de )?(animais|pets?|animal|cachorro)|(animais|pets?) (nao|proibid)|\bsem (animais|pets?)\b"
PETS = r"aceita(m|mos)? (animais|pets?|animal|cachorro)|pet ?friendly|permite(m)? (animais|pets?)|(animais|pets?) (sao )?(permitid|bem[ -]vind|aceit)"
NO_GUARANTOR = r"sem fiador|nao (exige|precisa de) fiador"
GUARANTEES = (
    ("Seguro-fiança", r"seguro[ -]?fianca|fianca locaticia|seguro de fianca"),
    ("Caução", r"caucao|deposito cau|(3|tres) (meses|alugueis) (de )?(deposito|adiantad)"),
    ("Título de capitalização", "capitalizacao"),
    ("Carta fiança", "carta ?fianca"),
    ("Cartão de crédito", "cartao de credito"),
)
#: Families for duplicate matching (coarse) and for statistics and facets (fixed values).
MATCH_FAMILY = {"apartamento": "ap", "kitnet": "ap", "studio": "ap", "cobertura": "ap", "flat": "ap", "casa": "casa", "sobrado": "casa", "casa_condominio": "casa", "comercial": "com", "terreno": "ter", "rural": "rur", "outro": "?"}
STAT_FAMILY = {"kitnet": "kitnet/studio", "studio": "kitnet/studio", "apartamento": "apartamento", "cobertura": "apartamento", "flat": "apartamento", "casa": "casa", "sobrado": "casa", "casa_condominio": "casa em condomínio"}


def _first(rules, otherwise: Column) -> Column:
    """A CASE over (condition, value) rules, the first that holds."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise)


def map_type(*parts: Column) -> Column:
    """Type from a platform's labels."""
    given = F.concat_ws(" ", *[F.when(p != "", p) for p in parts])
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(strip_accents(given)), "[_-]+", " "), F.lit(" "))
    return _first(((t.rlike(p), k) for k, p in TYPE_RULES), F.lit("outro"))


def refine_type(kind: Column, title: Column) -> Column:
    """A residential type made more exact by the title."""
    t = F.concat(F.lit(" "), F.lower(strip_accents(F.coalesce(title, F.lit("")))), F.lit(" "))
    return _first(((kind.isin(*of) & t.rlike(p), new) for of, p, new in REFINE_RULES), kind)


def infer_furnished(*texts: Column) -> Column:
    t = norm(*texts)
    return F.when(t.rlike(NOT_FURNISHED), False).when(t.rlike(FURNISHED), True)


def infer_pet(*texts: Column) -> Column:
    t = norm(*texts)
    return F.when(t.rlike(NO_PETS), False).when(t.rlike(PETS), True)


def infer_guarantees(*texts: Column) -> Column:
    t = norm(*texts)
    lead = F.when(t.rlike(NO_GUARANTOR), "Sem fiador").when(t.rlike(r"\bfiador\b"), "Fiador")
    return F.array_compact(F.array(lead, *[F.when(t.rlike(p), label) for label, p in GUARANTEES]))


def from_dict(c: Column, values: dict, otherwise: Column | None = None) -> Column:
    """Dictionary lookup; ``otherwise`` for keys that are missing."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, c)
    return found if otherwise is None else F.coalesce(found, otherwise)


#: What a type is called on screen, and the types that a facet of the type stands for (fixed values).
TYPE_LABELS = {"apartamento": "Apartamento", "kitnet": "Kitnet", "studio": "Studio", "cobertura": "Cobertura", "flat": "Flat", "casa": "Casa", "sobrado": "Sobrado", "casa_condominio": "Casa em condomínio", "comercial": "Comercial", "terreno": "Terreno", "rural": "Rural", "outro": "Imóvel"}
FACET_TYPES = {"apartamento": ("apartamento", "cobertura", "flat"), "kitnet": ("kitnet", "studio"), "casa": ("casa", "sobrado"), "casa_condominio": ("casa_condominio",)}


def type_label(kind: Column) -> Column:
    return from_dict(kind, TYPE_LABELS)


def facet_types(name: str) -> tuple[str, ...]:
    return FACET_TYPES.get(name, (name,))


def match_family(kind: Column) -> Column:
    return from_dict(kind, MATCH_FAMILY, F.lit("?"))


def stat_family(kind: Column) -> Column:
    return from_dict(kind, STAT_FAMILY, kind)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
