"""Merging a crawl into the state: insert, update by field policy, deactivate; change-only price history.

One full outer join on the key; every column's rule is an expression. ``now`` is a parameter, so a
merge is a function of its inputs. Rows of a source may be deactivated only if its scan was complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compute_total, dedupe_contacts, uniq
from ..schema import DETAIL_FIELDS, LIFECYCLE, LISTING, columns

HISTORY = 20


def key(fonte: Column, id_: Column) -> Column:
    return F.concat_ws(":", fonte, id_)


def is_empty(c: Column, kind: str) -> Column:
    """Null, no elements, or no characters; false and zero are not empty."""
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull() | (c == "") if kind == "string" else c.isNull()


def default_row(df: DataFrame, schema: str = LISTING, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with every column of the schema, missing ones null, or empty lists, or false; and the columns ``keep``."""
    out = []
    for name, kind in columns(schema):
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if kind.startswith("array"):
            c = F.coalesce(c, F.array().cast(kind))
        elif name in ("coord_aprox", "detalhado"):
            c = F.coalesce(c, F.lit(False))
        out.append(c.alias(name))
    return df.select(*out, *keep)


def overlay(listing: DataFrame, detail: DataFrame, on: list[str]) -> DataFrame:
    """Detail fields that are not null or empty win over the listing's; such rows are detailed.

    ``detail`` has the key columns and fields under their own names; the key is that of the list.
    """
    kinds = dict(columns(LISTING))
    d = detail.select(*on, *[F.col(c).alias(f"_{c}") for c in detail.columns if c not in on], F.lit(True).alias("_found"))
    joined = listing.join(d, on, "left")
    out = []
    for c in listing.columns:
        if c == "detalhado":
            out.append((F.coalesce(F.col("_found"), F.lit(False)) | F.coalesce(F.col(c), F.lit(False))).alias(c))
        elif f"_{c}" in d.columns:
            out.append(F.when(~is_empty(F.col(f"_{c}"), kinds.get(c, "double")), F.col(f"_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def merged(name: str, kind: str) -> Column:
    """A listing field of an updated row, from p (stored) and n (incoming)."""
    p, n = F.col(f"p.{name}"), F.col(f"n.{name}")
    if name == "detalhado":
        return F.coalesce(p, F.lit(False)) | F.coalesce(n, F.lit(False))
    if name in ("lat", "lng", "coord_aprox"):
        return F.when(F.col("n.lat").isNull() | F.col("n.lng").isNull(), p).otherwise(n)
    if name not in DETAIL_FIELDS:
        return n
    kept = F.when(is_empty(n, kind) & ~is_empty(p, kind), p).otherwise(n)
    if name == "fotos":
        return F.when(F.size(n) < F.size(p), p).otherwise(kept)
    if name in ("contatos", "caracteristicas"):
        none = F.array().cast(kind)
        both = F.concat(F.coalesce(p, none), F.coalesce(n, none))
        fused = dedupe_contacts(both) if name == "contatos" else uniq(both)
        return F.when(F.coalesce(F.col("p.detalhado"), F.lit(False)) & ~F.coalesce(F.col("n.detalhado"), F.lit(False)), fused.cast(kind)).otherwise(kept)
    return kept


def merged_total(rent: Column | None = None, condo: Column | None = None, tax: Column | None = None) -> Column:
    """The larger of the incoming total and the sum of the merged parts; none of either is null."""
    parts = [c if c is not None else merged(n, "double") for n, c in (("aluguel", rent), ("condominio", condo), ("iptu", tax))]
    return F.nullif(F.greatest(F.coalesce(F.col("n.total"), F.lit(0.0)), F.coalesce(compute_total(*parts), F.lit(0.0))), F.lit(0.0))


def append_history(history: Column, day: Column, rent: Column, total: Column) -> Column:
    """History with a new point if the rent differs from the last one's (null-safe); the last 20 stay."""
    last = F.try_element_at(history, F.lit(-1))["aluguel"]
    grown = F.concat(history, F.array(F.struct(day.alias("data"), rent.alias("aluguel"), total.alias("total"))))
    kept = F.when(F.size(grown) > HISTORY, F.slice(grown, -HISTORY, HISTORY)).otherwise(grown)
    return F.when((F.size(history) > 0) & last.eqNullSafe(rent), history).otherwise(kept)


def first_of_key(batch: DataFrame) -> DataFrame:
    """One row a key of a scan: the first by ``ord``."""
    w = Window.partitionBy("fonte", "id").orderBy("ord")
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply_results(state: DataFrame, batch: DataFrame, complete: DataFrame, now: str) -> DataFrame:
    """The new state with a column ``acao``: inserir, atualizar, desativar or manter.

    ``batch`` has listing columns and ``ord``; ``complete`` has (fonte, completo) for each scanned source.
    """
    day = F.lit(now[:10])
    n = first_of_key(batch).withColumn("chave", key(F.col("fonte"), F.col("id"))).alias("n")
    p = state.alias("p")
    top = F.broadcast(state.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("top")))  # one row
    done = F.broadcast(complete.where("completo").select(F.col("fonte").alias("done")).distinct())  # a row for each source
    j = p.join(n, F.col("p.chave") == F.col("n.chave"), "full_outer").join(done, F.col("p.fonte") == F.col("done"), "left").crossJoin(top)
    new, seen = F.col("p.chave").isNull(), F.col("n.chave").isNotNull()
    gone = ~seen & F.col("done").isNotNull() & F.coalesce(F.col("p.ativo"), F.lit(False))
    action = F.when(new, "inserir").when(seen, "atualizar").when(gone, "desativar").otherwise("manter")
    j = j.withColumn("acao", action)
    fields = columns(LISTING)
    j = j.withColumns({f"m_{name}": F.when(new, F.col(f"n.{name}")).when(seen, merged(name, kind)).otherwise(F.col(f"p.{name}")) for name, kind in fields})
    total = merged_total(F.col("m_aluguel"), F.col("m_condominio"), F.col("m_iptu"))
    j = j.withColumn("m_total", F.when(seen & ~new, F.when(F.col("m_aluguel").isNotNull(), total)).otherwise(F.col("m_total")))
    kinds = dict(columns(LIFECYCLE))
    start = F.array(F.struct(day.alias("data"), F.col("m_aluguel").alias("aluguel"), F.col("m_total").alias("total"))).cast(kinds["historico_precos"])
    life = {
        "chave": F.coalesce("p.chave", "n.chave"),
        "primeira_vez": F.when(new, F.lit(now)).otherwise(F.col("p.primeira_vez")),
        "ultima_vez": F.when(seen, F.lit(now)).otherwise(F.col("p.ultima_vez")),
        "ativo": F.when(seen, True).when(gone, False).otherwise(F.col("p.ativo")),
        "inativo_desde": F.when(seen, F.lit(None).cast("string")).when(gone, F.lit(now)).otherwise(F.col("p.inativo_desde")),
        "historico_precos": F.when(new, start).when(seen, append_history(F.col("p.historico_precos"), day, F.col("m_aluguel"), F.col("m_total"))).otherwise(F.col("p.historico_precos")),
        "status": F.when(new, "novo").otherwise(F.col("p.status")),
        "notas": F.when(new, "").otherwise(F.col("p.notas")),
        "ord": F.when(new, F.col("top") + 1 + F.col("n.ord")).otherwise(F.col("p.ord")),
    }
    return j.select(*[F.col(f"m_{name}").cast(kind).alias(name) for name, kind in fields], *[life.get(name, F.col(f"p.{name}")).cast(kind).alias(name) for name, kind in kinds.items()], "acao")


def to_detail(batch: DataFrame, state: DataFrame, again: bool = False) -> DataFrame:
    """Rows whose detail page must be read: those not already detailed in the state, or all."""
    known = state.where("detalhado").select("chave")
    rows = batch.withColumn("chave", key(F.col("fonte"), F.col("id")))
    return rows if again else rows.join(known, "chave", "left_anti")


def union_scans(scans: list[DataFrame]) -> DataFrame:
    """The rows of several sources' scans, by column name; one at least."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out


def gone_rows(state: DataFrame, seen: DataFrame, complete: DataFrame) -> DataFrame:
    """Active rows of completely scanned sources whose key the scan did not see."""
    done = complete.where("completo").select("fonte").distinct()
    return state.where("ativo").join(done, "fonte", "left_semi").join(seen.select("chave"), "chave", "left_anti")


def in_keys(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys``."""
    return state.join(keys.select("chave"), "chave", "left_semi")


def news_of(run: DataFrame, news: DataFrame) -> DataFrame:
    """The new keys (inicio, pos, chave) of a run, one row or none."""
    return news.join(F.broadcast(run.select("inicio").limit(1)), "inicio", "left_semi")  # one row


def in_last_run(state: DataFrame, runs: DataFrame, news: DataFrame) -> DataFrame:
    """Rows that the last run found first."""
    return in_keys(state, news_of(last_run(runs), news))


def last_run(runs: DataFrame) -> DataFrame:
    """The latest run, one row or none."""
    return runs.orderBy(F.desc("inicio")).limit(1)


def new_in_order(run: DataFrame, news: DataFrame, state: DataFrame) -> DataFrame:
    """(pos, state row) of a run's new keys, ``pos`` being its order; keys no longer there are left out."""
    return news_of(run, news).select("pos", "chave").join(state, "chave")


def seen_span(observations: DataFrame, by: str, at: str, **last: tuple[str, list[str]]) -> DataFrame:
    """(by, primeira, ultima, ...): first and last sighting of each key, and values at the last by (column, order)."""
    return observations.groupBy(by).agg(F.min(at).alias("primeira"), F.max(at).alias("ultima"), *[F.max_by(c, F.struct(*order)).alias(n) for n, (c, order) in last.items()])


def run_summary(changes: DataFrame, scans: DataFrame, details: DataFrame) -> DataFrame:
    """One row a source of a run: ok, encontrados, novos, atualizados, removidos, detalhados, erro, avisos, ms.

    ``changes`` is a merge's result, ``scans`` has (fonte, encontrados, erro, avisos, ms), ``details`` one row a detail
    page read (fonte, ord, id, erro). The first three failures of details are told, the others counted: rows are
    ranked, and cut to three in every task, before any are gathered.
    """
    order = Window.partitionBy("fonte").orderBy("ord", "id", "erro")
    first = details.where("erro IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n <= 3")
    told = first.groupBy("fonte").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id", "erro"))), lambda x: F.concat(F.lit("detalhe "), x["id"], F.lit(": "), x["erro"])).alias("ditas"))
    many = F.count(F.col("erro"))
    more = F.when(many > 3, F.array(F.concat(F.lit("... e mais "), (many - 3).cast("string"), F.lit(" falhas de detalhe"))))
    d = details.groupBy("fonte").agg(F.count_if(F.col("erro").isNull()).alias("detalhados"), more.alias("outras"))
    none = F.array().cast("array<string>")
    counted = scans.join(run_counts(changes), "fonte", "left").join(d, "fonte", "left").join(told, "fonte", "left")
    n = lambda c: F.when(F.col("erro").isNull(), F.coalesce(c, F.lit(0))).otherwise(0).cast("int").alias(c)
    notes = F.concat(*[F.coalesce(c, none) for c in ("avisos", "ditas", "outras")]).alias("avisos")
    return counted.select("fonte", F.col("erro").isNull().alias("ok"), n("encontrados"), n("novos"), n("atualizados"), n("removidos"), n("detalhados"), "erro", notes, F.col("ms").cast("long").alias("ms"))


def run_news(changes: DataFrame, begin: str) -> DataFrame:
    """(inicio, pos, chave): the keys that a run found first; ``pos`` is their order in the state."""
    return changes.where("acao = 'inserir'").select(F.lit(begin).alias("inicio"), F.col("ord").alias("pos"), "chave")


def run_row(summary: DataFrame, begin: str, end: str) -> DataFrame:
    """The run log's row: its sources' summaries by id (a row for each configured source), and how many keys were new."""
    parts = [c for c in summary.columns if c != "fonte"]
    rows = summary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fonte", F.struct(*parts).alias("r"))))).alias("fontes"), F.coalesce(F.sum("novos"), F.lit(0)).alias("novos"))
    return rows.select(F.lit(begin).alias("id"), F.lit(begin).alias("inicio"), F.lit(end).alias("fim"), "fontes", "novos")


def run_counts(changes: DataFrame) -> DataFrame:
    """(fonte, novos, atualizados, removidos) of a merge."""
    return changes.groupBy("fonte").agg(F.count_if(F.col("acao") == "inserir").alias("novos"), F.count_if(F.col("acao") == "atualizar").alias("atualizados"), F.count_if(F.col("acao") == "desativar").alias("removidos"))


def price_changes(observations: DataFrame, by: list[str], order: list[str], price: str) -> DataFrame:
    """Rows of a series at which the price differs from the one before (the first always does)."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.lag(price).over(w)
    return observations.withColumn("_n", F.row_number().over(w)).withColumn("_b", before).where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(price))).drop("_n", "_b")


def last_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def price_drop(history: Column) -> Column:
    """How much the last price is below the one before, or null."""
    a, b = F.try_element_at(history, F.lit(-2))["aluguel"], F.try_element_at(history, F.lit(-1))["aluguel"]
    return F.when(b < a, a - b)
