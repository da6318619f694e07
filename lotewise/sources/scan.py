"""Paged scans replayed from captures: which pages a crawl reads before it stops, which rows it keeps, and whether it saw all.

A capture is one page of a source's results: ``fonte``, ``page`` (from 1), ``status`` (HTTP), ``html`` or the
parsed document, and for the aggregator the ``caminho`` it was found under. The stop rules of the
platforms look at pages in their order; here they are running sums over one small row a page, so a
source's listings are never gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.merge import first_of_key
from . import platforms
from .captured import paths_for
from .pages import looks_blocked, widget_state
from .platforms import AGGREGATOR_PAGE, AGGREGATOR_PAGES, KENLO_PAGE, MSYS_PAGE

#: States of a capture; a block is no proof that there are no results.
OK, MISSING, BLOCKED, FAILED = "ok", "ausente", "bloqueado", "erro"


@dataclass(frozen=True)
class Rule:
    """When a platform's scan stops: after a page of fewer than ``size`` entries, one without new ids, or once the total is reached."""

    size: int | None = None
    new: bool = False
    first_total: bool = True
    most: int = 20


RULES = {"msys": Rule(size=MSYS_PAGE, first_total=False), "ksi": Rule(new=True), "kenlo": Rule(size=KENLO_PAGE)}


def capture_status(status: Column, html: Column) -> Column:
    """ok, ausente (not there), bloqueado (anti-bot page) or erro."""
    return F.when(status.isin(404, 410), MISSING).when(looks_blocked(status, html), BLOCKED).when(status.between(200, 299), OK).otherwise(FAILED)


def page_facts(pages: DataFrame, platform: str) -> DataFrame:
    """(fonte, caminho, page, estado, total, entradas) of captured result pages (status, html), as the scans take them.

    A kenlo page whose state is missing is an error: the platform's marking has changed.
    """
    html, state = F.col("html"), capture_status(F.col("status"), F.col("html"))
    if platform == "msys":
        answer = F.try_parse_json(html)
        total, held = F.try_variant_get(answer, "$.response.numFound", "int"), F.try_variant_get(answer, "$.response.docs", "array<variant>")
    elif platform == "kenlo":
        listings = F.try_variant_get(widget_state(html, "listings"), "$.settings.listings", "variant")
        total, held = F.try_variant_get(listings, "$.count", "int"), F.try_variant_get(listings, "$.data", "array<variant>")
        state = F.when((state == OK) & listings.isNull(), FAILED).otherwise(state)
    elif platform == "ksi":
        total, held = platforms.ksi_total(html), F.slice(F.split(html, platforms.KSI_CARD), 2, 1 << 30)
    else:
        total, held = platforms.aggregator_total(html), F.try_variant_get(platforms.offer_list(html), "$.offers.itemListElement", "array<variant>")
    return pages.select("fonte", "caminho", "page", state.alias("estado"), total.alias("total"), F.coalesce(F.size(held), F.lit(0)).alias("entradas"))


def first_rows(rows: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """The first ``limit`` rows of each source in the order in which they were read; all without a limit."""
    if not limit or limit < 0:
        return rows
    w = Window.partitionBy("fonte").orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def search(pages: DataFrame, platform: str, *, city_slug: str = "", max_rent: float | None = None, types: list[str] | None = None, most: int | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of one platform's captured pages, as the data source gives them: parsed, scanned, cut to ``limit`` rows a source."""
    own = pages.where(F.col("plataforma") == platform)
    good = own.where(capture_status(F.col("status"), F.col("html")) == OK)
    facts = page_facts(own, platform)
    if platform == "chavesnamao":
        rows = platforms.aggregator(good, city_slug, keep=("caminho", "page", "pos"))
        held = rows.groupBy("fonte", "caminho", "page").agg(F.count(F.lit(1)).cast("int").alias("entradas"))  # offers elsewhere or for sale do not count
        facts = facts.drop("entradas").join(held, ["fonte", "caminho", "page"], "left").fillna(0, ["entradas"])
        kept, sources = scan_aggregator(rows, facts, max_rent, types, most or AGGREGATOR_PAGES)
        place = F.array_position(F.array(*map(F.lit, paths_for(types))), F.col("caminho"))
        return first_rows(kept.withColumn("_p", place), limit, "_p", "page", "pos").drop("_p"), sources
    parser = platforms.platform(platform)
    rows = parser(platforms.msys_docs(good, ("page",)) if platform == "msys" else good, keep=("page", "pos"))
    kept, sources = scan(rows, facts.drop("caminho"), platform, most)
    return first_rows(kept, limit, "page", "pos"), sources


def scan(rows: DataFrame, pages: DataFrame, platform: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of a scan by a platform's rule.

    ``rows`` are listings with ``page`` and ``pos``; ``pages`` has ``fonte``, ``page``, ``estado`` (of ``capture_status``),
    ``total`` that the page announces and ``entradas`` that it holds. Kept are each id's first row on the
    pages read. ``sources`` has fonte, paginas, encontrados, total, completo, erro.
    """
    rule = RULES[platform]
    # ids that a page is the first to have; summed before the shuffle
    firsts = rows.groupBy("fonte", "id").agg(F.min("page").alias("page"))
    new = firsts.groupBy("fonte", "page").agg(F.count(F.lit(1)).alias("novos"))
    by = Window.partitionBy("fonte").orderBy("page")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    p = pages.where(F.col("page") <= (most or rule.most)).join(new, ["fonte", "page"], "left").fillna(0, ["novos"])
    ok = F.col("estado") == OK
    p = p.withColumns({"lidos": F.sum("novos").over(upto), "n": F.row_number().over(by), "alvo": (F.first("total", ignorenulls=False) if rule.first_total else F.last("total", ignorenulls=True)).over(upto)})
    reached = F.coalesce(F.col("lidos") >= F.col("alvo"), F.lit(False))
    end = ~ok | reached | (F.col("n") != F.col("page"))
    if rule.size:
        end = end | (F.col("entradas") < rule.size)
    if rule.new:
        end = end | (F.col("novos") == 0)
    before = F.max(end.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    p = p.withColumns({"fim": end, "alcancado": reached}).withColumn("antes", F.coalesce(before, F.lit(0))).where("antes = 0 AND page = n")
    read = p.where(ok).select("fonte", "page")
    # nothing left: a page that is not there, or one that met the rule
    done = F.bool_or(F.col("fim") & F.col("estado").isin(OK, MISSING))
    if not rule.first_total:
        done = F.max_by("alvo", "page").isNull() | F.bool_or("alcancado")
    failed = F.max(F.when(F.col("estado").isin(BLOCKED, FAILED), F.col("estado")))
    sources = p.groupBy("fonte").agg(F.count_if(ok).cast("int").alias("paginas"), F.sum(F.when(ok, F.col("novos")).otherwise(0)).cast("int").alias("encontrados"), F.max_by("alvo", "page").alias("total"), (done & failed.isNull()).alias("completo"), failed.alias("erro"))
    kept = first_of_key(rows.join(read, ["fonte", "page"], "left_semi").withColumn("ord", F.struct("page", "pos"))).drop("ord")
    return kept, sources


def scan_aggregator(rows: DataFrame, pages: DataFrame, max_rent: float | None = None, types: list[str] | None = None, most: int = AGGREGATOR_PAGES) -> tuple[DataFrame, DataFrame]:
    """(rows, sources) of the aggregator's paths that can hold the types: five pages of each are all it allows.

    Prices are filtered here, unknown ones stay. ``sources`` has fonte, encontrados, total, completo, avisos.
    """
    most = min(most, AGGREGATOR_PAGES)
    wanted = paths_for(types)
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col("caminho"))
    by = Window.partitionBy("fonte", "caminho").orderBy("page")
    p = pages.where(F.col("caminho").isin(*wanted) & (F.col("page") <= most)).withColumns({"alvo": F.first("total").over(by), "n": F.row_number().over(by)})
    end = (F.col("estado") != OK) | F.col("alvo").isNull() | (F.col("page") * AGGREGATOR_PAGE >= F.col("alvo")) | (F.col("entradas") == 0)
    before = F.coalesce(F.max(end.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    p = p.withColumn("antes", before).where((F.col("antes") == 0) & (F.col("page") == F.col("n")))
    read = p.where(F.col("estado") == OK).select("fonte", "caminho", "page")
    by_path = p.groupBy("fonte", "caminho").agg(F.max("alvo").alias("total"))
    over = F.col("total") > most * AGGREGATOR_PAGE
    note = F.concat("caminho", F.lit(" tem "), F.col("total").cast("string"), F.lit(f" anúncios, mas só {most * AGGREGATOR_PAGE} podem ser lidos ({most} páginas)"))
    sources = by_path.groupBy("fonte").agg(F.nullif(F.sum("total"), F.lit(0)).cast("int").alias("total"), (F.count_if(over) == 0).alias("completo"), F.transform(F.array_sort(F.collect_list(F.when(over, F.struct(place.alias("o"), note.alias("t"))))), lambda x: x["t"]).alias("avisos"))
    kept = first_of_key(rows.join(read, ["fonte", "caminho", "page"], "left_semi").withColumn("ord", F.struct(place, F.col("page"), F.col("pos")))).drop("ord")
    if max_rent is not None:
        kept = kept.where(F.col("aluguel").isNull() | (F.col("aluguel") <= max_rent))
    found = kept.groupBy("fonte").agg(F.count(F.lit(1)).cast("int").alias("encontrados"))
    return kept, sources.join(found, "fonte", "left").fillna(0, ["encontrados"])
