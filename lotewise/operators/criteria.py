"""Filters: search criteria, facets, text search, tab counts, orderings and one row per group."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import all_of, facet_types, refine_type, type_label
from ..functions.text import norm, plain, slugify, strip_accents
from ..schema import NON_RESIDENTIAL, STATUSES


def meets_criteria(listings: DataFrame, max_rent: float, types: list[str], min_rooms: int = 0, city: str | None = None) -> DataFrame:
    """Rows that a search is after, with the type refined. Unknown rent, rooms and city pass; so does type outro."""
    rows = listings.withColumn("tipo", refine_type(F.col("tipo"), F.col("titulo")))
    kind = F.col("tipo")
    conds = [~kind.isin(*NON_RESIDENTIAL), kind.isin(*types, "outro"), F.col("aluguel").isNull() | (F.col("aluguel") <= max_rent)]
    if min_rooms > 0:
        conds.append(F.col("quartos").isNull() | (F.col("quartos") >= min_rooms))
    if city:
        conds.append(F.col("cidade").isNull() | (F.col("cidade") == "") | (slugify(F.col("cidade")) == slugify(F.lit(city))))
    return rows.where(all_of(conds))


def cost(base: str = "aluguel") -> Column:
    return F.coalesce("total", "aluguel") if base == "total" else F.col("aluguel")


def _searched(fields: tuple[Column, ...]) -> Column:
    """The fields as one text without accents and case; the accents of ASCII texts need no looking for."""
    once = lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.lower(strip_accents(t)))
    return F.get(F.transform(F.array(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])), once), F.lit(0))


def _wanted(query: str) -> list[Column]:
    return [F.trim(norm(F.lit(w))) for w in query.split()]


def matches_text(query: str, *fields: Column) -> Column:
    """Every word of the query occurs in the fields, whatever the accents and case."""
    words = _wanted(query)
    # the text is bound once, however many words are looked for in it
    return F.exists(F.array(_searched(fields)), lambda t: all_of([F.contains(t, w) for w in words])) if words else F.lit(True)


#: Trigrams of a text are marked in a bitmap of this many bytes for each character of it, between the least and the most.
SIGNATURE_BYTES, LEAST_BYTES, MOST_BYTES = 0.25, 16, 4096


def with_signature(rows: DataFrame, *fields: Column) -> DataFrame:
    """Rows with ``assinatura``, a bitmap of the trigrams of their fields: to be stored, and tested before the texts.

    A trigram is a bit of the bitmap, by its hash; a bitmap has room for the text's length, so long texts do not fill theirs.
    """

    @F.pandas_udf("binary")
    def mark(text: pd.Series) -> pd.Series:
        return text.map(_bitmap)

    return rows.withColumn("assinatura", mark(_searched(fields)))


def _trigrams(text: str) -> np.ndarray:
    """A hash of every three characters in a row."""
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(x) < 3:
        return np.zeros(0, np.uint64)
    h = (x[:-2] << np.uint64(42)) ^ (x[1:-1] << np.uint64(21)) ^ x[2:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _bitmap(text: str) -> bytes:
    size = 1 << (int(min(MOST_BYTES, max(LEAST_BYTES, SIGNATURE_BYTES * len(text)))) - 1).bit_length()
    bits = np.zeros(8 * size, np.uint8)
    bits[_trigrams(text) & np.uint64(8 * size - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_match(query: str, signature: Column) -> Column:
    """Whether a signature has every trigram of the query's words; false means that no text with it matches."""
    hashes = sorted({int(h) for w in plain(query).lower().split() for h in _trigrams(w)})
    bits = F.octet_length(signature) * 8
    at = lambda h: F.lit(h & (8 * MOST_BYTES - 1)).bitwiseAND(bits - 1)  # noqa: E731  sizes are powers of two
    byte = lambda h: F.conv(F.hex(F.substring(signature, F.shiftright(at(h), 3) + 1, F.lit(1))), 16, 10).cast("int")
    return all_of([F.expr("true")] + [F.getbit(byte(h), at(h) % 8) == 1 for h in hashes])


def search_text(rows: DataFrame, query: str, *fields: Column) -> DataFrame:
    """Rows whose fields have every word of the query; where they have signatures, few texts are looked at."""
    return rows.where(may_match(query, F.col("assinatura"))).where(matches_text(query, *fields)) if "assinatura" in rows.columns else rows.where(matches_text(query, *fields))


def facets(*, tab: str = "todos", ceiling: float | None = None, base: str = "aluguel", rooms: int | None = None, family: str | None = None, source: str | None = None, pet: bool = False, furnished: bool = False, parking: bool = False, new_since: str | None = None, text: str = "", inactive: bool = False, any_tab: bool = False) -> Column:
    """The facet predicate. Unknown price passes the ceiling, unknown rooms fail the rooms facet."""
    conds = []
    if not inactive:
        conds.append(F.col("ativo").eqNullSafe(True))
    if not any_tab:
        conds.append(F.col("status") != "descartado" if tab == "todos" else F.col("status") == tab)
    if ceiling is not None:
        conds.append(cost(base).isNull() | (cost(base) <= ceiling))
    if rooms:
        conds.append(F.coalesce(F.col("quartos") >= rooms, F.lit(False)))
    if family:
        conds.append(F.col("tipo").isin(*facet_types(family)))
    if source:
        conds.append(F.col("fonte") == source)
    if pet:
        conds.append(F.col("aceita_pet").eqNullSafe(True))
    if furnished:
        conds.append(F.col("mobiliado").eqNullSafe(True))
    if parking:
        conds.append(F.coalesce(F.col("vagas") > 0, F.lit(False)))
    if new_since is not None:
        conds.append(F.col("primeira_vez") == new_since)
    if text.strip():
        conds.append(matches_text(text, *[F.col(c) for c in ("titulo", "bairro", "endereco", "anunciante", "descricao", "referencia")], type_label(F.col("tipo"))))
    return all_of(conds)


def tab_counts(state: DataFrame, statuses: list[str], **kw) -> DataFrame:
    """Rows in each tab under all other facets, before groups are folded."""
    rows = state.where(facets(any_tab=True, **kw))
    return rows.agg(F.count_if(F.col("status") != "descartado").alias("todos"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


#: Orderings by name: (key, whether it falls); each ends in ``ord`` so that ties keep their order.
KEYS = {
    "recentes": lambda: [(F.coalesce("primeira_vez", F.lit("")), True), (F.coalesce("atualizado_em", F.lit("")), True), (F.col("ord"), False)],
    "preco": lambda: [(F.coalesce("aluguel", F.lit(1e9)), False), (F.col("ord"), False)],
    "total": lambda: [(F.coalesce("total", "aluguel", F.lit(1e9)), False), (F.col("ord"), False)],
    "m2": lambda: [(F.when(F.col("area") > 0, F.coalesce("aluguel", F.lit(0.0)) / F.col("area")).otherwise(1e9), False), (F.col("ord"), False)],
    "area": lambda: [(F.coalesce("area", F.lit(-1.0)), True), (F.col("ord"), False)],
    "ia": lambda: [(F.coalesce("ia.nota", F.lit(-1)), True), (F.col("ord"), False)],
    "lista": lambda: [(F.coalesce("primeira_vez", F.lit("")), True), (F.coalesce("aluguel", F.lit(1e9)), False), (F.col("ord"), False)],
}


def _sorting(keys: Callable[[], list[tuple[Column, bool]]]) -> Callable[[], list[Column]]:
    return lambda: [k.desc() if falls else k for k, falls in keys()]


#: The same as sort expressions.
ORDERS = {name: _sorting(keys) for name, keys in KEYS.items()}


def position(order: str = "recentes") -> Column:
    """Where a row stands in an order, as an array of its keys for ``after``."""
    return F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(KEYS.get(order, KEYS["recentes"])())])


def after(order: str, place: tuple) -> Column:
    """Rows that come after a position: the first key that differs is beyond the position's."""
    keys = KEYS.get(order, KEYS["recentes"])()
    ways = []
    for i, (k, falls) in enumerate(keys):
        beyond = k < F.lit(place[i]) if falls else k > F.lit(place[i])
        ways.append(all_of([*[q == F.lit(v) for (q, _), v in zip(keys[:i], place[:i], strict=True)], beyond]))
    return functools.reduce(operator.or_, ways)


def first_per_group(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each group in the given order; rows without a group all stay."""
    w = Window.partitionBy(F.coalesce("grupo", F.concat(F.lit("k:"), F.col("chave")))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listing(state: DataFrame, where: Column | None = None, order: str = "recentes", limit: int | None = None, offset: int = 0, since: tuple | None = None) -> DataFrame:
    """Filter, then fold groups, then sort and cut: the representative is the best row that passed.

    ``since`` is the position of a page's last row: the next page begins after it, without the rows before being sorted again.
    """
    by = ORDERS.get(order, ORDERS["recentes"])()
    rows = first_per_group(state.where(where) if where is not None else state, by)
    rows = (rows.where(after(order, since)) if since is not None else rows).orderBy(*by)
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit and limit > 0 else rows


def page_of(state: DataFrame, where: Column | None = None, order: str = "recentes", limit: int | None = None) -> DataFrame:
    """``listing`` with ``de``, the number of rows before the limit, in every row; no or a non-positive limit takes all."""
    by = ORDERS.get(order, ORDERS["recentes"])()
    rows = first_per_group(state.where(where) if where is not None else state, by)
    total = rows.agg(F.count(F.lit(1)).alias("de"))  # one row
    counted = rows.crossJoin(F.broadcast(total)).orderBy(*by)  # a sort below the join would be lost
    return counted.limit(limit) if limit and limit > 0 else counted


def console_filter(state: DataFrame, *, every: bool = False, status: str | None = None, last_run: DataFrame | None = None, unread: bool = False) -> DataFrame:
    """The console's list filters: active rows unless ``every``; of a status; among ``last_run``, the keys that the last run found first; without an annotation and not discarded."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    rows = state if every else state.where("ativo")
    if status:
        rows = rows.where(F.col("status") == status)
    if unread:
        rows = rows.where(F.col("ia").isNull() & (F.col("status") != "descartado"))
    return rows if last_run is None else rows.join(last_run.select("chave"), "chave", "left_semi")


def health(rows: DataFrame, sources: DataFrame, by: str = "fonte", scans: DataFrame | None = None) -> DataFrame:
    """Verdict on each source's scan: blocked (inconclusive), no rows, degraded (over half without price, or bad titles), or ok.

    ``sources`` names every source scanned, so that one without rows is told; ``scans`` (by, erro) has
    the error of those that failed.
    """
    bad = F.coalesce(F.col("titulo").rlike(r"(?i)&[a-z]+;|<\w+"), F.lit(False)) | ~F.coalesce(F.col("url").startswith("http"), F.lit(False))
    a = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("aluguel").isNull()).alias("sem_preco"), F.count_if(bad).alias("ruins"))
    out = sources.select(by).distinct().join(a, by, "left").fillna(0, ["n", "sem_preco", "ruins"])
    out = out.join(scans.select(by, "erro"), by, "left") if scans is not None else out.withColumn("erro", F.lit(None).cast("string"))
    verdict = F.when(F.col("erro") == "bloqueado", "inconclusivo").when(F.col("erro").isNotNull(), "erro").when(F.col("n") == 0, "sem resultados")
    return out.withColumn("veredito", verdict.when((F.col("sem_preco") * 2 > F.col("n")) | (F.col("ruins") > 0), "degradado").otherwise("ok")).drop("erro")
