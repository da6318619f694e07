"""Queries of the listing operators over whole tables, each with DuckDB SQL for the same rows where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import commands, criteria, merge, resolve, transitions, views
from ..schema import STATE
from ..sources.platforms import variant_number
from ..sources.shared import dropped, stored
from .facade import LISTINGS, OBSERVATIONS, listings, observations, state, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_L = f"WITH l AS ({LISTINGS}) "
_O = f"WITH o AS ({OBSERVATIONS}) "
_ORDER = ["ts", "l_orderkey", "l_linenumber"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_FAMILY = "CASE WHEN tipo IN ('kitnet', 'studio') THEN 'kitnet/studio' WHEN tipo IN ('apartamento', 'cobertura', 'flat') THEN 'apartamento' WHEN tipo IN ('casa', 'sobrado') THEN 'casa' WHEN tipo = 'casa_condominio' THEN 'casa em condomínio' ELSE tipo END"
_H = "floor(round({}, 8) * 100 + 0.5e0) / 100.0e0"


@query(
    _L
    + f"""SELECT concat({_FAMILY}, ' · ', CASE WHEN quartos IS NULL THEN '?' WHEN quartos >= 3 THEN '3+' ELSE concat('', quartos) END, ' quartos') AS grupo, count(*) AS n,
        {_H.format("quantile_cont(aluguel::DOUBLE, 0.25)")} AS p25, {_H.format("quantile_cont(aluguel::DOUBLE, 0.5)")} AS mediana, {_H.format("quantile_cont(aluguel::DOUBLE, 0.75)")} AS p75,
        {_H.format("quantile_cont(CASE WHEN area > 5 THEN aluguel / area END, 0.5)")} AS mediana_m2
    FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(grupo, concat('k:', chave)) ORDER BY ord) AS rn FROM l WHERE ativo AND aluguel IS NOT NULL) WHERE rn = 1 GROUP BY 1"""
)
def market_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.market_stats(listings(spark, sf_dir))


@query(_L + "SELECT count(*) AS total, count(*) FILTER (ativo) AS ativos, count(*) FILTER (ativo AND status <> 'descartado') AS sem_ia, count(DISTINCT grupo) FILTER (ativo) AS grupos FROM l")
def state_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(state(spark, sf_dir)).select("total", "ativos", "sem_ia", "grupos")


@query(_L + f"SELECT chave FROM l WHERE ativo AND status <> 'descartado' AND (aluguel IS NULL OR aluguel <= 1200) AND quartos >= 2 AND {_FAMILY} = 'casa' AND aceita_pet AND vagas > 0")
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).where(criteria.facets(ceiling=1200, rooms=2, family="casa", pet=True, parking=True)).select("chave")


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'tion') AND contains(strip_accents(lower(coalesce(text, ''))), 'reti')")
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(criteria.matches_text(" Tiôn  reti ", F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'tion') AND contains(strip_accents(lower(coalesce(text, ''))), 'reti') UNION ALL SELECT doc_id FROM documents WHERE contains(strip_accents(lower(coalesce(text, ''))), 'zuungein')")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches over rows that are stored with signatures: texts without the trigrams are not looked at."""
    rows = stored(criteria.with_signature(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text")), "signatures")
    found = [criteria.search_text(rows, q, F.col("text")).select("doc_id") for q in ("Tiôn  reti", "ZUUNGEIN")]
    return merge.union_scans(found)


@query(_L + "SELECT count(*) FILTER (status <> 'descartado') AS todos, count(*) FILTER (status = 'novo') AS novo, count(*) FILTER (status = 'descartado') AS descartado FROM l WHERE ativo AND (aluguel IS NULL OR aluguel <= 1500)")
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria.tab_counts(listings(spark, sf_dir), ["novo", "descartado"], ceiling=1500)


@query(_L + "SELECT chave, grupo, aluguel FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(grupo, concat('k:', chave)) ORDER BY primeira_vez DESC, coalesce(aluguel, 1e9), ord) AS rn FROM l WHERE ativo) WHERE rn = 1")
def list_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria.listing(listings(spark, sf_dir), F.col("ativo"), "lista").select("chave", "grupo", "aluguel")


def _ranked(sql_order: str) -> str:
    return f"SELECT chave, rank FROM (SELECT *, row_number() OVER (ORDER BY {sql_order}) AS rank FROM l) WHERE rank <= 60"


@query(_L + f"SELECT 'preco' AS ordem, * FROM ({_ranked('coalesce(aluguel, 1e9), ord')}) UNION ALL SELECT 'm2', * FROM ({_ranked('CASE WHEN area > 0 THEN coalesce(aluguel, 0) / area ELSE 1e9 END, ord')}) UNION ALL SELECT 'area', * FROM ({_ranked('coalesce(area, -1) DESC, ord')})")
def orderings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 60 in three orders; the top-k comes before the rank, so only 60 rows are numbered."""
    out = None
    for name in ("preco", "m2", "area"):
        by = criteria.ORDERS[name]()
        top = listings(spark, sf_dir).orderBy(*by).limit(60)
        part = top.select(F.lit(name).alias("ordem"), "chave", F.row_number().over(Window.orderBy(*by)).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def scan_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("fonte"), F.sha2("text", 256).alias("id"), F.col("doc_id").alias("ord"))
    return merge.first_of_key(docs).select(F.col("ord").alias("doc_id"))


@query(_O + "SELECT chave, l_orderkey, l_linenumber, aluguel FROM (SELECT *, lag(aluguel) OVER w AS b, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY chave ORDER BY ts, l_orderkey, l_linenumber)) WHERE n = 1 OR b IS DISTINCT FROM aluguel")
def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.price_changes(observations(spark, sf_dir), ["chave"], _ORDER, "aluguel").select("chave", "l_orderkey", "l_linenumber", "aluguel")


@query(_O + "SELECT chave, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY chave ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM o) WHERE n <= 2")
def history_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_n(observations(spark, sf_dir), ["chave"], [F.desc(c) for c in _ORDER], 2).select("chave", "l_orderkey", "l_linenumber")


@query(_O + "SELECT chave, floor((b - aluguel) * 100 + 0.5e0) / 100.0e0 AS queda FROM (SELECT *, lag(aluguel) OVER (PARTITION BY chave ORDER BY ts, l_orderkey, l_linenumber) AS b, row_number() OVER (PARTITION BY chave ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM o) WHERE n = 1 AND aluguel < b")
def price_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = merge.last_n(observations(spark, sf_dir), ["chave"], [F.desc(c) for c in _ORDER], 2)
    hist = last.groupBy("chave").agg(F.array_sort(F.collect_list(F.struct(*_ORDER, "aluguel"))).alias("h"))
    return hist.select("chave", text.half_up(merge.price_drop(F.col("h")), 2).alias("queda")).where("queda IS NOT NULL")


@query(_O + "SELECT chave, min(ts) AS primeira, max(ts) AS ultima, arg_max(aluguel, struct_pack(a := ts, b := l_orderkey, c := l_linenumber)) AS aluguel FROM o GROUP BY chave")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.seen_span(observations(spark, sf_dir), "chave", "ts", aluguel=("aluguel", _ORDER))


_CUT = "TIMESTAMP '1996-01-01'"
_LAST = "SELECT chave, fonte, aluguel FROM (SELECT *, row_number() OVER (PARTITION BY chave ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM o WHERE {}) WHERE n = 1"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = observations(spark, sf_dir)
    last = lambda df: df.groupBy("chave", "fonte").agg(F.max_by("aluguel", F.struct(*_ORDER)).alias("aluguel"))
    return last(o.where(f"ts < {_CUT}")), last(o.where(f"ts >= {_CUT}"))


@query(_O + f", a AS ({_LAST.format('ts < ' + _CUT)}), b AS ({_LAST.format('ts >= ' + _CUT)}) SELECT coalesce(a.chave, b.chave) AS chave, coalesce(b.aluguel, a.aluguel) AS aluguel, CASE WHEN a.chave IS NULL THEN 'inserir' WHEN b.chave IS NOT NULL THEN 'atualizar' WHEN a.fonte % 2 = 0 THEN 'desativar' ELSE 'manter' END AS acao, CASE WHEN a.chave IS NULL THEN 1 WHEN b.chave IS NOT NULL AND a.aluguel <> b.aluguel THEN 2 ELSE 1 END AS pontos FROM a FULL JOIN b ON a.chave = b.chave")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the observations merged into a state made of the first; even sources were scanned completely."""
    from ..schema import STATE

    old, new = _halves(spark, sf_dir)
    part = lambda df: df.select(F.split("chave", ":")[1].alias("id"), F.col("fonte").cast("string").alias("fonte"), "aluguel", F.col("aluguel").alias("total"), "chave", F.crc32(F.col("chave").cast("binary")).alias("ord"))
    hist = F.array(F.struct(F.lit("1995-12-31").alias("data"), "aluguel", "total"))
    stored = merge.default_row(part(old).withColumns({"ativo": F.lit(True), "historico_precos": hist, "status": F.lit("novo")}), STATE)
    batch = merge.default_row(part(new)).withColumn("ord", F.lit(0).cast("long"))
    done = part(old).select("fonte").unionByName(part(new).select("fonte")).distinct().withColumn("completo", F.col("fonte").cast("int") % 2 == 0)
    out = merge.apply_results(stored, batch, done, "1996-01-01T00:00:00Z")
    return out.select("chave", "aluguel", "acao", F.size("historico_precos").alias("pontos"))


@query(_O + f"SELECT DISTINCT chave FROM o WHERE ts >= {_CUT} AND chave NOT IN (SELECT chave FROM o WHERE ts < {_CUT})")
def new_keys_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    batch = new.select(F.col("fonte").cast("string").alias("fonte"), F.split("chave", ":")[1].alias("id"))
    return merge.to_detail(batch, old.withColumn("detalhado", F.lit(True))).select("chave")


@query(_O + f"SELECT DISTINCT chave FROM o WHERE ts < {_CUT} AND fonte % 2 = 0 AND chave NOT IN (SELECT chave FROM o WHERE ts >= {_CUT})")
def disappeared_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    done = old.select("fonte").distinct().withColumn("completo", F.col("fonte") % 2 == 0)
    return merge.gone_rows(old.withColumn("ativo", F.lit(True)), new, done).select("chave")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def semi_last_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the state; those with a returned item are the run's new keys."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("chave"))
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "chave")
    return merge.in_keys(rows, back).select(F.col("chave").alias("o_orderkey"))


@query("SELECT c_custkey, c_name, n_nationkey AS fonte FROM customer JOIN nation ON c_nationkey = n_nationkey")
def advertiser_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer advertises as "Imobiliária <nation> Ltda"; the source is the nation of that name."""
    nation = table(spark, sf_dir, "nation")
    src = nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_nationkey").alias("pos"), F.lit("msys").alias("plataforma"), F.concat(F.lit("Nação "), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("nome"), F.array().cast("array<string>").alias("apelidos"))
    ads = table(spark, sf_dir, "customer").withColumn("anunciante", F.concat(F.lit("Imobiliária NACAO "), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"), F.lit(" Ltda")))
    return ads.join(resolve.resolve_source(ads, src), "anunciante").select("c_custkey", "c_name", F.col("fonte_resolvida").cast("int").alias("fonte"))


_PAIR = "x.ord < y.ord AND x.fonte <> y.fonte AND x.aluguel = y.aluguel AND x.familia = y.familia AND x.bairro = y.bairro AND x.quartos = y.quartos AND abs(x.area - y.area) <= greatest(2.0e0, 0.04e0 * greatest(x.area, y.area)) AND x.vagas = y.vagas"


@query(
    f"WITH p AS ({LISTINGS}), l AS (SELECT chave, ord, fonte, floor(aluguel / 100) AS aluguel, CASE WHEN tipo IN ('apartamento', 'kitnet', 'studio') THEN 'ap' WHEN tipo IN ('casa', 'sobrado', 'casa_condominio') THEN 'casa' WHEN tipo = 'terreno' THEN 'ter' ELSE '?' END AS familia, bairro, quartos, area, vagas FROM p WHERE ativo) SELECT x.chave AS a, y.chave AS b FROM l x JOIN l y ON {_PAIR}"
)
def attribute_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of equal rent (by the hundred), family, neighbourhood and rooms with areas that agree."""
    rows = state(spark, sf_dir).withColumn("aluguel", F.floor(F.col("aluguel") / 100).cast("double"))
    return resolve.attribute_edges(rows).select("a", "b")


#: Every listing has a reference that some of its source share, and aggregators' ones name another source.
_NAMED = """SELECT l.*, concat('AP 0', ord % 50) AS referencia, n_name AS anunciante FROM l JOIN nation ON n_nationkey = 1 + ord % 6"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Listings with references and advertisers, and the catalogue of sources: a nation each."""
    nation = table(spark, sf_dir, "nation")
    rows = state(spark, sf_dir).withColumn("referencia", F.concat(F.lit("AP 0"), F.col("ord") % 50)).drop("anunciante")
    rows = rows.join(nation.select(F.col("n_name").alias("anunciante"), F.col("n_nationkey").alias("k")), F.col("k") == 1 + F.col("ord") % 6).drop("k")
    return rows, nation.select(F.concat(F.lit("f"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("pos"), F.lit("msys").alias("plataforma"), F.col("n_name").alias("nome"), F.array().cast("array<string>").alias("apelidos"))


@query(
    _L
    + f""", a AS ({_NAMED}), d AS (SELECT fonte, ord % 50 AS ref, max(ord) AS ord FROM a WHERE ativo AND plataforma <> 'chavesnamao' GROUP BY 1, 2)
    SELECT a.chave AS anuncio, t.chave AS alvo FROM a JOIN d ON d.fonte = concat('f', 1 + a.ord % 6) AND d.ref = a.ord % 50 JOIN a t ON t.ord = d.ord WHERE a.ativo AND a.plataforma = 'chavesnamao'"""
)
def reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregator's listing and the direct one that it names: the last of that source with the reference."""
    rows, src = _named(spark, sf_dir)
    return resolve.reference_edges(rows, resolve.resolve_source(rows.where("ativo"), src)).select(F.col("a").alias("anuncio"), F.col("b").alias("alvo"))


_LETTERS = "concat('f:', CASE WHEN p_partkey % 2 = 0 THEN 'k' ELSE 'K' END, p_size)"


@query(f"SELECT grupo, chave FROM (SELECT p_brand AS grupo, {_LETTERS} AS chave, row_number() OVER (PARTITION BY p_brand ORDER BY lower({_LETTERS}), {_LETTERS} DESC) AS n FROM part) WHERE n = 1")
def group_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows alike but for their keys: the first key as a reader orders words, small letters before great ones."""
    rows = merge.default_row(table(spark, sf_dir, "part").select(F.col("p_brand").alias("grupo"), F.expr(_LETTERS).alias("chave"), F.lit("msys").alias("plataforma"), F.lit("2024-01-01").alias("primeira_vez")), STATE)
    return resolve.principals(rows).select("grupo", "chave")


@query()
def groups_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References are the first edges, equal attributes the others."""
    rows, src = _named(spark, sf_dir)
    rows = rows.withColumn("aluguel", F.floor(F.col("aluguel") / 100).cast("double"))
    return resolve.assign_groups(rows, src, lambda df: stored(df, "groups"), drop=dropped).select("chave", "grupo")


@query(_L + "SELECT a.chave, string_agg(b.chave, ',' ORDER BY b.ord) AS outros FROM l a JOIN l b ON a.grupo = b.grupo AND a.chave <> b.chave GROUP BY a.chave")
def also_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.group_members(listings(spark, sf_dir)).where(F.size("outros") > 0)
    return m.select("chave", F.array_join(F.transform("outros", lambda x: x["chave"]), ",").alias("outros"))


@query(_L + "SELECT regexp_replace(lower(bairro), '[^a-z0-9]+', ' ', 'g') AS bairro_norm, round(avg(lat), 6) AS c_lat, round(avg(lng), 6) AS c_lng FROM l WHERE lat IS NOT NULL GROUP BY 1")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.centroids(listings(spark, sf_dir)).select("bairro_norm", F.round("c_lat", 6).alias("c_lat"), F.round("c_lng", 6).alias("c_lng"))


@query(_L + ", c AS (SELECT bairro, avg(lat) AS a, avg(lng) AS b FROM l WHERE lat IS NOT NULL GROUP BY 1) SELECT chave, round(coalesce(lat, a), 6) AS lat, round(coalesce(lng, b), 6) AS lng, lat IS NULL AND a IS NOT NULL AS coord_aprox FROM l LEFT JOIN c ON l.bairro = c.bairro")
def coords_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.with_coordinates(state(spark, sf_dir)).select("chave", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "coord_aprox")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Clique' WHEN 'view' THEN 'Visita' ELSE event_type END AS rotulo FROM events")
def dictionary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", classify.from_dict(F.col("event_type"), {"click": "Clique", "view": "Visita"}, F.col("event_type")).alias("rotulo"))


@query("SELECT o_orderkey, coalesce(c_name, concat('', o_custkey)) AS nome FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("nome"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("fonte"))
    return views.named_source(orders, names).select("o_orderkey", F.col("fonte_nome").alias("nome"))


@query("SELECT c_custkey AS chave, coalesce(s, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def overlay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("chave")).agg(F.min("o_orderpriority").alias("c_mktsegment"))
    return commands.overlay_local(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chave"), "c_mktsegment"), local)


@query(_L + "SELECT chave, titulo FROM l WHERE chave = 'f0:77'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.lookup(listings(spark, sf_dir), "f0:77").select("chave", "titulo")


@query("SELECT CAST(ts AS DATE) AS dia, count(*) FILTER (event_type = 'click') AS novos, count(*) FILTER (event_type = 'view') AS atualizados, count(*) FILTER (event_type = 'purchase') AS removidos FROM events GROUP BY 1")
def run_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = classify.from_dict(F.col("event_type"), {"click": "inserir", "view": "atualizar", "purchase": "desativar"})
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("fonte"), kind.alias("acao"))
    return merge.run_counts(e).withColumnRenamed("fonte", "dia")


@query(
    """WITH p AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, * FROM pages), s AS (SELECT DISTINCT host FROM p UNION ALL SELECT 'vazio.example' UNION ALL SELECT 'recusa.example' UNION ALL SELECT 'quebra.example'),
    a AS (SELECT host, count(*) AS n, count(*) FILTER (page_id % 3 = 0) AS sem_preco, count(*) FILTER (NOT starts_with(url, 'http') OR page_id % 97 = 0) AS ruins FROM p GROUP BY 1)
    SELECT s.host, coalesce(n, 0) AS n, coalesce(sem_preco, 0) AS sem_preco, coalesce(ruins, 0) AS ruins,
        CASE WHEN s.host = 'recusa.example' THEN 'inconclusivo' WHEN s.host = 'quebra.example' THEN 'erro' WHEN n IS NULL THEN 'sem resultados' WHEN sem_preco * 2 > n OR ruins > 0 THEN 'degradado' ELSE 'ok' END AS veredito
    FROM s LEFT JOIN a ON s.host = a.host"""
)
def health_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each host is a source, three more have no rows; every 97th title has an entity left in it."""
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url", F.when(F.col("page_id") % 97 == 0, "Casa &atilde; venda").otherwise("Casa").alias("titulo"), F.when(F.col("page_id") % 3 != 0, 1.0).alias("aluguel"))
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("vazio.example", "recusa.example", "quebra.example")))).alias("host"))
    failed = spark.range(1).select(F.inline(F.array(F.struct(F.lit("recusa.example").alias("host"), F.lit("bloqueado").alias("erro")), F.struct(F.lit("quebra.example").alias("host"), F.lit("erro").alias("erro")))))
    return criteria.health(rows, rows.select("host").unionByName(more), "host", failed)


@query("SELECT conv_id, arg_min(turn, struct_pack(a := CASE WHEN role = 'assistant' AND turn % 2 = 1 THEN 0 WHEN turn % 2 = 1 THEN 1 ELSE 2 END, b := turn)) AS turno FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE turn IS NOT NULL AND role IS NOT NULL) GROUP BY conv_id")
def best_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as contacts: odd ones have WhatsApp, every one a phone."""
    c = F.struct("turn", F.when(F.col("role") == "assistant", "corretor").otherwise("anunciante").alias("papel"), F.when(F.col("turn") % 2 == 1, "55").alias("whatsapp"), F.col("turn").cast("string").alias("telefone"))
    g = table(spark, sf_dir, "conversations").where("turn IS NOT NULL AND role IS NOT NULL").select("conv_id", "turn", "role").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(c)).alias("contatos"))
    return g.select("conv_id", views.best_contact(F.col("contatos"))["turn"].alias("turno"))


@query("SELECT user_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS status, max(ts) AS status_em FROM events GROUP BY user_id")
def funnel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands.status_from_events(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


#: A reader's presses, made from events: five kinds, of which one sets a status.
_PRESS = "CASE event_type WHEN 'purchase' THEN 'contatar' WHEN 'signup' THEN 'favoritar' WHEN 'error' THEN 'descartar' WHEN 'click' THEN 'desfazer' ELSE 'marcar' END"
_MARK = "CASE CAST(floor(coalesce(value, 0)) AS INT) % 6 WHEN 0 THEN 'novo' WHEN 1 THEN 'interesse' WHEN 2 THEN 'contatado' WHEN 3 THEN 'visita' WHEN 4 THEN 'proposta' ELSE 'descartado' END"


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id, {_PRESS} AS k, {_MARK} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL),
    r AS (
        SELECT user_id, 0::BIGINT AS n, 'novo' AS status, CAST(NULL AS VARCHAR) AS antes FROM (SELECT DISTINCT user_id FROM e)
        UNION ALL
        SELECT r.user_id, e.n,
            CASE e.k WHEN 'marcar' THEN e.s WHEN 'desfazer' THEN coalesce(r.antes, r.status) WHEN 'favoritar' THEN CASE r.status WHEN 'interesse' THEN 'novo' ELSE 'interesse' END
                WHEN 'descartar' THEN CASE r.status WHEN 'descartado' THEN 'novo' ELSE 'descartado' END ELSE CASE WHEN r.status IN ('novo', 'interesse') THEN 'contatado' ELSE r.status END END,
            CASE WHEN e.k = 'desfazer' THEN NULL WHEN e.k = 'contatar' AND r.status NOT IN ('novo', 'interesse') THEN r.antes ELSE r.status END
        FROM r JOIN e ON r.user_id = e.user_id AND e.n = r.n + 1
    ) SELECT user_id, arg_max(status, n) AS status, max(n) AS eventos FROM r GROUP BY 1"""
)
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a history of contacts, stars, discards, settings and undoings leads."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_PRESS).alias("evento"), F.expr(_MARK).alias("para"))
    h = transitions.histories(e, "user_id", "evento", "para", ["ts", "event_id"])
    return h.select("user_id", transitions.status_after(F.lit("novo"), F.col("map")).alias("status"), F.col("n").alias("eventos"))


@query("SELECT page_id, trim(regexp_replace(strip_accents(lower(url)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def slug_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"), F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))


_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style).*?</(script|style)>', ' ', 'gis'), '<\\s*br\\s*/?>', chr(10), 'gi'), '</(p|li|div|h[0-9]|tr|ul|ol|section|article)>', chr(10), 'gi'), '<li[^>]*>', '- ', 'gi'), '<[^>]+>', ' ', 'g')"
_DECODED = f"replace(replace(replace(replace({_STRIPPED}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@query(
    f"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace({_DECODED}, chr(13), ''), concat('[ ', chr(9), chr(160), ']+'), ' ', 'g'), concat(' ?', chr(10), ' ?'), chr(10), 'g'), concat(chr(10), '{{3,}}'), concat(chr(10), chr(10)), 'g') AS t FROM pages)
    SELECT page_id, nullif(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '') AS texto FROM t"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text itself of every page; the pages' own entities are four, ``entities`` has others."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("texto"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS valor FROM lineitem")
def parse_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in Brazilian notation and read back."""
    written = F.concat(F.lit("R$ "), F.translate(F.format_number("l_extendedprice", 2), ",.", ".,"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.parse_brl(written).alias("valor"))


@query("SELECT c_custkey, concat('(14) 9', lpad(concat('', c_custkey % 10000), 4, '0'), '-', lpad(concat('', c_custkey % 9973), 4, '0')) AS telefone, concat('55149', lpad(concat('', c_custkey % 10000), 4, '0'), lpad(concat('', c_custkey % 9973), 4, '0')) AS whatsapp FROM customer")
def parse_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.concat(F.lit("+55 014 9"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" "), F.lpad((F.col("c_custkey") % 9973).cast("string"), 4, "0"))
    raw = F.regexp_replace(d, r"^\+55 014", "+55 14")  # the area code alone, not digits of the number
    c = text.make_contact("corretor", F.col("c_name"), raw)
    return table(spark, sf_dir, "customer").select("c_custkey", c["telefone"].alias("telefone"), c["whatsapp"].alias("whatsapp"))


@query(_L + "SELECT chave, CASE WHEN contains(lower(descricao), 'studio') THEN 'studio' WHEN contains(lower(descricao), 'flat') THEN 'flat' ELSE 'outro' END AS classe FROM l")
def classify_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select("chave", classify.map_type(F.col("descricao")).alias("classe"))


@query(_L + "SELECT chave FROM l WHERE tipo <> 'terreno' AND (aluguel IS NULL OR aluguel <= 1400) AND (quartos IS NULL OR quartos >= 1) AND (cidade IS NULL OR cidade = 'Botucatu')")
def search_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = ["apartamento", "kitnet", "studio", "casa", "sobrado", "casa_condominio"]
    return criteria.meets_criteria(listings(spark, sf_dir), 1400, types, 1, "BOTUCATU").select("chave")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", variant_number(F.try_parse_json("props"), "$.k").cast("int").alias("k"))


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS papeis FROM (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE trim(role) <> '' GROUP BY 1, 2) GROUP BY 1")
def set_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return g.select("conv_id", F.array_join(text.uniq(F.transform("t", lambda x: x["role"])), ",").alias("papeis")).where("papeis <> ''")


@query("SELECT c_name AS nome, c_nationkey AS pais, 'c' AS origem FROM customer UNION ALL SELECT s_name, s_nationkey, 's' FROM supplier")
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("nome"), F.col("c_nationkey").alias("pais"), F.lit("c").alias("origem"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("origem"), F.col("s_nationkey").alias("pais"), F.col("s_name").alias("nome"))
    return merge.union_scans([c, s])


@query(_L + "SELECT chave, titulo, aluguel, substr(descricao, 1, 700) AS descricao, ativo FROM l")
def compact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.compact(state(spark, sf_dir)).select("chave", "titulo", "aluguel", "descricao", "ativo")


@query(_L + "SELECT min(lat) AS min_lat, max(lat) AS max_lat, min(lng) AS min_lng, max(lng) AS max_lng, count(lat) AS localizados, count(*) - count(lat) AS sem_local FROM l")
def map_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.extent(listings(spark, sf_dir))
