"""Queries of text rules, classifiers, commands, runs and views over whole benchmark tables, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import commands, criteria, crawl, merge, views
from ..schema import STATE
from ..sources import config
from ..sources.shared import stored
from .facade import LISTINGS, listings, state, table
from .queries import query

_L = f"WITH l AS ({LISTINGS}) "
_NOW = "2024-02-01T12:00:00Z"


def _pick(values: tuple[str, ...], by: str) -> str:
    """One of some texts by a number, as an expression."""
    return "CASE " + " ".join(f"WHEN {by} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


#: Labels and the type that each must get, in the order of the rules.
_LABELS = (
    ("Kit Net", "kitnet"), ("STUDIO_APARTMENT", "kitnet"), ("Loft", "studio"), ("Apartamento flat", "flat"), ("Penthouse", "cobertura"), ("Chácara", "rural"), ("small-farm", "rural"), ("Lote", "terreno"), ("Casa comercial", "comercial"), ("PARKING", "comercial"),
    ("Casas em Condomínio", "casa_condominio"), ("TWO_STORY_HOUSE", "sobrado"), ("Casa", "casa"), ("residência", "casa"), ("Aptos", "apartamento"), ("xyz", "outro"), ("lotes", "outro"),
)


@query(f"SELECT p_partkey, {_pick(tuple(k for _, k in _LABELS), 'p_partkey')} AS tipo FROM part")
def classify_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.map_type(F.expr(_pick(tuple(v for v, _ in _LABELS), "p_partkey"))).alias("tipo"))


_TITLES = (
    ("apartamento", "KITINETE nova", "kitnet"), ("flat", "estúdio", "studio"), ("outro", "Cobertura duplex", "cobertura"), ("casa", "Casa em condomínio", "casa_condominio"), ("casa", "Lindo SOBRADO", "sobrado"), ("outro", "casa boa", "casa"), ("outro", "Apto 2q", "apartamento"),
    ("apartamento", "Sala grande", "apartamento"), ("terreno", "casa", "terreno"), ("casa", "kitnet", "casa"),
)


@query(f"SELECT p_partkey, {_pick(tuple(x[2] for x in _TITLES), 'p_partkey')} AS tipo FROM part")
def refine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.expr(_pick(tuple(x[i] for x in _TITLES), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.refine_type(at(0), at(1)).alias("tipo"))


#: Texts with what they say of furniture (1, 0 or nothing), pets, and guarantees.
_HINTS = (
    ("Não mobiliado, aceita pets", "0", "1", ""), ("Semi mobiliado. Proibido animais", "1", "0", ""), ("com móveis; pet friendly; sem fiador", "1", "1", "Sem fiador"), ("Vazio, sem móveis", "0", "", ""), ("fiador ou seguro fiança ou caução", "", "", "Fiador|Seguro-fiança|Caução"),
    ("não aceitamos cachorro; título de capitalização", "", "0", "Título de capitalização"), ("carta-fiança? carta fiança, cartão de crédito", "", "", "Carta fiança|Cartão de crédito"), ("três meses de depósito, não exige fiador", "", "", "Sem fiador|Caução"), ("sem animais", "", "0", ""), ("casa", "", "", ""),
)


@query(f"SELECT p_partkey, CASE {_pick(tuple(x[1] for x in _HINTS), 'p_partkey')} WHEN '1' THEN true WHEN '0' THEN false END AS mobiliado, CASE {_pick(tuple(x[2] for x in _HINTS), 'p_partkey')} WHEN '1' THEN true WHEN '0' THEN false END AS aceita_pet, {_pick(tuple(x[3] for x in _HINTS), 'p_partkey')} AS garantias FROM part")
def infer_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr(_pick(tuple(x[0] for x in _HINTS), "p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", classify.infer_furnished(t).alias("mobiliado"), classify.infer_pet(t).alias("aceita_pet"), F.array_join(classify.infer_guarantees(t), "|").alias("garantias"))


@query(
    """SELECT p_partkey, concat('Vila São ', p_size, ' de Botucatu') AS nome, concat(CASE WHEN p_size % 2 = 0 THEN 'na' ELSE 'no' END) AS prep, concat('Sao-', p_size, '-Manuel') AS titulo, concat(CASE WHEN p_size % 3 = 0 THEN 'jardim paraiso ' WHEN p_size % 3 = 1 THEN 'vila nossa senhora ' ELSE 'parque doutor ' END, p_size) AS bairro,
    concat('casa ', p_size) AS empresa, concat('AP', p_size, 'B') AS ref, concat('&lt;', p_size, '&gt; &amp; &#39;x&#39; &quot;') AS html, concat('a%20', p_size, '%2F%C3%A7') AS link, concat('x', p_size, chr(10), 'y', chr(10), chr(10), 'z') AS linhas FROM part"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.fix_upper_case(e("concat('VILA S&Atilde;O ', p_size, '  DE BOTUCATU')")).alias("nome"), text.preposition(e("CASE WHEN p_size % 2 = 0 THEN 'Chácara X' ELSE 'Jardim Y' END")).alias("prep"), text.title_slug(e("concat('são ', p_size, ' MANUEL')")).alias("titulo"),
        text.normalize_bairro(e("concat(CASE WHEN p_size % 3 = 0 THEN 'Jd. Paraíso (' WHEN p_size % 3 = 1 THEN 'VL NSA (' ELSE 'Pq. Dr. (' END, p_size, ')')")).alias("bairro"), text.normalize_name(e("concat('Imobiliária Casa ', p_size, ' Negócios Imobiliários Ltda')")).alias("empresa"),
        text.norm_ref(e("concat('ap-', p_size, '/b')")).alias("ref"), text.escape_html(e("concat('<', p_size, '> & ''x'' \\\"')")).alias("html"), text.link_text(e("concat('a ', p_size, '/ç')")).alias("link"), text.clean_multiline(e("concat(' x', p_size, chr(13), chr(10), '  y ', chr(10), chr(10), chr(10), ' z ')")).alias("linhas"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1234567.89e0 WHEN 1 THEN p_size * 1000e0 WHEN 2 THEN p_size + 0.5e0 WHEN 3 THEN NULL WHEN 4 THEN p_size * 1.0e0 ELSE 1234.56e0 END AS valor, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN NULL WHEN 2 THEN 3 ELSE 0 END AS inteiro,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE -22.5e0 END AS coord, CASE WHEN p_size % 2 = 0 THEN p_size * 1.0e0 END AS positivo, floor((p_retailprice + p_size) * 100 + 0.5e0) / 100.0e0 AS total, concat('R$ 1.', lpad(concat('', p_size), 3, '0'), CASE WHEN p_size % 2 = 1 THEN ',5' ELSE '' END) AS texto, p_size * 1.0e0 AS arredondado FROM part"""
)
def number_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.expr
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.parse_brl(e("CASE p_partkey % 6 WHEN 0 THEN 'R$ 1.234.567,89' WHEN 1 THEN concat(p_size, '.000') WHEN 2 THEN concat(p_size, ',5 m²') WHEN 3 THEN 'Sob consulta' WHEN 4 THEN concat('R$ ', p_size, '.') ELSE '1,234.56' END")).alias("valor"),
        text.parse_int(e("CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' vagas') WHEN 1 THEN '-2' WHEN 2 THEN '2.5' ELSE 'nenhum' END")).alias("inteiro"), text.parse_coord(e("CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE ' -22.5' END")).alias("coord"), text.positive_or_null(e("CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END")).alias("positivo"),
        text.compute_total(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(None).cast("double")).alias("total"), text.brl(e("1000 + p_size + CASE WHEN p_size % 2 = 1 THEN 0.5D ELSE 0D END")).alias("texto"), text.half_up(e("p_size - 0.5D")).alias("arredondado"),
    )


@query("SELECT conv_id, string_agg(concat(nome, '/', digitos, '/', coalesce(email, '')), '|' ORDER BY primeiro) AS contatos FROM (SELECT conv_id, role AS nome, concat('(14) 3000-0', lpad(concat('', min(turn) % 1000), 3, '0')) AS digitos, CASE WHEN count(*) > 1 THEN 'x@y.z' END AS email, min(turn) AS primeiro FROM (SELECT DISTINCT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY conv_id, role) GROUP BY conv_id")
def contacts_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role's turns are one contact under the number of its first; its later turns bring an address."""
    c = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "turn", "role").distinct()
    w = Window.partitionBy("conv_id", "role")
    c = c.withColumn("first", F.min("turn").over(w))
    phone = F.concat(F.lit("14 3000-0"), F.lpad((F.col("first") % 1000).cast("string"), 3, "0"))
    made = text.make_contact("anunciante", F.col("role"), phone, email=F.when(F.col("turn") > F.col("first"), "x@y.z"))
    g = c.select("conv_id", "turn", "role", made.alias("c")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "c"))), lambda x: x["c"]).alias("cs"))
    return g.select("conv_id", F.array_join(F.transform(text.dedupe_contacts(F.col("cs")), lambda x: F.concat_ws("/", x["nome"], x["telefone"], F.coalesce(x["email"], F.lit("")))), "|").alias("contatos"))


_ALL = "ativo AND status <> 'descartado'"
_FACETS = {
    "aba": (dict(tab="visita"), "ativo AND status = 'visita'"), "inativos": (dict(inactive=True), "status <> 'descartado'"), "preco": (dict(ceiling=1000.0), f"{_ALL} AND (aluguel IS NULL OR aluguel <= 1000)"), "quartos": (dict(rooms=3), f"{_ALL} AND quartos >= 3"),
    "familia": (dict(family="kitnet"), f"{_ALL} AND tipo IN ('kitnet', 'studio')"), "tipo": (dict(family="terreno"), f"{_ALL} AND tipo = 'terreno'"), "fonte": (dict(source="f3"), f"{_ALL} AND fonte = 'f3'"), "pet": (dict(pet=True), f"{_ALL} AND aceita_pet"), "vaga": (dict(parking=True), f"{_ALL} AND vagas > 0"),
    "novos": (dict(new_since="2024-01-15"), f"{_ALL} AND primeira_vez = '2024-01-15'"), "texto": (dict(text="condominio  CASA"), f"{_ALL} AND tipo = 'casa_condominio'"), "mobiliado": (dict(furnished=True), f"{_ALL} AND p_mob"), "total": (dict(base="total", ceiling=1200.0), f"{_ALL} AND (aluguel IS NULL OR aluguel + 100 <= 1200)"),
}


@query(_L + ", m AS (SELECT *, ord % 5 = 0 AS p_mob FROM l) " + " UNION ALL ".join(f"SELECT '{k}' AS faceta, count(*) AS n, CAST(sum(ord) AS BIGINT) AS soma FROM m WHERE {sql}" for k, (_, sql) in _FACETS.items()))
def all_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every facet alone: one pass, a count and a sum of the rows' numbers for each."""
    rows = state(spark, sf_dir).withColumns({"mobiliado": F.when(F.col("ord") % 5 == 0, True).when(F.col("ord") % 5 == 1, False), "total": F.col("aluguel") + 100, "titulo": F.lit("x"), "descricao": F.lit(None).cast("string")})
    aggs = [x for k, (kw, _) in _FACETS.items() for x in (F.count_if(criteria.facets(**kw)).alias(f"n_{k}"), F.sum(F.when(criteria.facets(**kw), F.col("ord"))).alias(f"s_{k}"))]
    one = rows.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("faceta"), F.col(f"n_{k}").alias("n"), F.col(f"s_{k}").alias("soma")) for k in _FACETS])))


_ORDERS = {"recentes": "primeira_vez DESC, ord", "total": "coalesce(CASE WHEN ord % 2 = 0 THEN aluguel + 500 END, aluguel, 1e9), ord", "ia": "CASE WHEN ord % 3 = 0 THEN ord % 100 ELSE -1 END DESC, ord"}


@query(_L + " UNION ALL ".join(f"SELECT '{k}' AS ordem, chave, rank FROM (SELECT chave, row_number() OVER (ORDER BY {by}) AS rank FROM l) WHERE rank <= 60" for k, by in {**_ORDERS, "desconhecida": _ORDERS["recentes"]}.items()))
def more_orderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other three orders, and an unknown name, which means the most recent."""
    rows = state(spark, sf_dir).withColumns({"total": F.when(F.col("ord") % 2 == 0, F.col("aluguel") + 500), "ia": F.when(F.col("ord") % 3 == 0, F.struct((F.col("ord") % 100).cast("int").alias("nota")))})
    out = []
    for name in (*_ORDERS, "desconhecida"):
        by = criteria.ORDERS.get(name, criteria.ORDERS["recentes"])()
        out.append(rows.orderBy(*by).limit(60).select(F.lit(name).alias("ordem"), "chave", F.row_number().over(Window.orderBy(*by)).alias("rank")))
    return merge.union_scans(out)


@query(_L + ", f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(grupo, concat('k:', chave)) ORDER BY primeira_vez DESC, coalesce(aluguel, 1e9), ord) AS rn FROM l WHERE ativo AND status = 'visita'), g AS (SELECT *, count(*) OVER () AS de FROM f WHERE rn = 1) SELECT chave, de FROM g ORDER BY primeira_vez DESC, coalesce(aluguel, 1e9), ord LIMIT 20")
def limited_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria.page_of(criteria.console_filter(state(spark, sf_dir), status="visita"), None, "lista", 20).select("chave", "de")


def _in_place(df: DataFrame, name: str) -> DataFrame:
    """Rows with ``lugar``, their place in the order that ``df`` gives: a place in the partition, and the sizes of those before."""
    rows = stored(df.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    begins = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.withColumn("_part", part).join(begins, "_part").withColumn("lugar", F.col("before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_part", "before")


@query(_L + " UNION ALL ".join(f"SELECT '{k}' AS pedido, chave, count(*) OVER () AS de, row_number() OVER (ORDER BY coalesce(aluguel, 1e9), ord) AS lugar FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(grupo, concat('k:', chave)) ORDER BY coalesce(aluguel, 1e9), ord) AS rn FROM l WHERE ativo) WHERE rn = 1" for k in ("None", "0")))
def whole_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without a limit, or with one of zero, is whole and in order."""
    out = [_in_place(criteria.page_of(state(spark, sf_dir), F.col("ativo"), "preco", n), "list").select(F.lit(str(n)).alias("pedido"), "chave", "de", "lugar") for n in (None, 0)]
    return merge.union_scans(out)


@query(_L + "SELECT chave, CAST(rank AS INTEGER) AS lugar, CAST(1 + (rank - 1) // 60 AS INTEGER) AS pagina FROM (SELECT chave, row_number() OVER (ORDER BY primeira_vez DESC, coalesce(aluguel, 1e9), ord) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(grupo, concat('k:', chave)) ORDER BY primeira_vez DESC, coalesce(aluguel, 1e9), ord) AS rn FROM l WHERE ativo) WHERE rn = 1) WHERE rank <= 120")
def next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of sixty rows; the second begins after the position of the first one's last row."""
    rows, out, since = state(spark, sf_dir), [], None
    for page in (1, 2):
        got = criteria.listing(rows, F.col("ativo"), "lista", 60, since=since).withColumn("_at", criteria.position("lista"))
        w = Window.orderBy(*criteria.ORDERS["lista"]())  # a page
        ranked = got.withColumn("_n", F.row_number().over(w))
        last = ranked.orderBy(F.desc("_n")).select("_at").first()
        since = tuple(last["_at"]) if last else since
        out.append(ranked.select("chave", (F.col("_n") + 60 * (page - 1)).alias("lugar"), F.lit(page).alias("pagina")))
    return merge.union_scans(out)


_RUNS = "SELECT concat('2024-01-', lpad(concat('', 1 + event_id % 28), 2, '0'), 'T', lpad(concat('', event_id % 24), 2, '0')) AS inicio, event_id FROM events"


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New keys of runs: an event is one, the day and hour of its number are its run, the part of the next number its key."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.expr("concat('2024-01-', lpad(concat('', 1 + event_id % 28), 2, '0'), 'T', lpad(concat('', event_id % 24), 2, '0'))").alias("inicio"), n.alias("pos"), F.concat(F.lit("f"), ((n + 1) % 7).cast("string"), F.lit(":"), (n + 1).cast("string")).alias("chave"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log of those keys."""
    ok = lambda f, n: F.struct(F.lit(f).alias("fonte"), F.struct(F.lit(f != "f2").alias("ok"), F.lit(n).alias("encontrados")).alias("r"))
    return _news(spark, sf_dir).groupBy("inicio").agg(F.count(F.lit(1)).alias("novos")).withColumns({"id": F.col("inicio"), "fim": F.concat("inicio", F.lit("F")), "fontes": F.map_from_entries(F.array(ok("f1", 3), ok("f2", 0), ok("x9", 0)))})


@query(_L + f", r AS ({_RUNS}), u AS (SELECT max(inicio) AS m FROM r), n AS (SELECT event_id FROM r, u WHERE inicio = m) SELECT event_id AS pos, l.chave, aluguel FROM n JOIN l ON l.chave = concat('f', (event_id + 1) % 7, ':', event_id + 1)")
def last_run_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run's new keys in its order; those that the state lacks are left out."""
    return merge.new_in_order(merge.last_run(_runs(spark, sf_dir)), _news(spark, sf_dir), listings(spark, sf_dir)).select("pos", "chave", "aluguel")


@query(_L + f", r AS ({_RUNS}) SELECT chave FROM l WHERE chave IN (SELECT concat('f', (event_id + 1) % 7, ':', event_id + 1) FROM r WHERE inicio = (SELECT max(inicio) FROM r)) AND ativo AND status <> 'descartado'")
def console_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return criteria.console_filter(state(spark, sf_dir), last_run=merge.news_of(merge.last_run(_runs(spark, sf_dir)), _news(spark, sf_dir)), unread=True).select("chave")


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("concat('f', n_nationkey) AS id", "n_nationkey AS pos", "n_name AS nome", "'msys' AS plataforma", "concat('https://', n_name) AS url", "n_nationkey % 2 = 0 AS ativo", "cast(null AS string) AS aviso")


@query(_L + f", r AS ({_RUNS}) SELECT (SELECT count(*) FROM l WHERE ativo) AS ativos, (SELECT concat(max(inicio), 'F') FROM r) AS ultima, (SELECT concat(n_name, '|x9') FROM nation WHERE n_nationkey = 2) AS falhas, (SELECT string_agg(n_name, '|' ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 7) AS usadas")
def page_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third source has no name in the catalogue and failed, as the second did."""
    runs = _runs(spark, sf_dir).withColumn("fontes", F.transform_values("fontes", lambda k, v: v.withField("ok", k == "f1")))
    h = views.header(listings(spark, sf_dir), runs, _sources(spark, sf_dir))
    return h.select("ativos", "ultima", F.array_join("falhas", "|").alias("falhas"), F.array_join("usadas", "|").alias("usadas"))


@query(_L + f", r AS ({_RUNS}), s AS (SELECT status, count(*) AS n FROM l WHERE ativo GROUP BY 1), f AS (SELECT fonte, count(*) AS n FROM l WHERE ativo GROUP BY 1) SELECT (SELECT string_agg(concat(status, '=', n), ',' ORDER BY status) FROM s) AS por_status, (SELECT string_agg(concat(fonte, '=', n), ',' ORDER BY fonte) FROM f) AS por_fonte, (SELECT max(inicio) FROM r) AS inicio, CAST((SELECT count(*) FROM r WHERE inicio = (SELECT max(inicio) FROM r)) AS BIGINT) AS novos")
def summary_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.summary(state(spark, sf_dir), _runs(spark, sf_dir))
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias(m)
    return s.select(flat("por_status"), flat("por_fonte"), "ultima_busca.inicio", F.col("ultima_busca.novos").alias("novos"))


@query("SELECT event_id, CASE WHEN d < 90 THEN 'agora há pouco' WHEN d < 3600 THEN concat('há ', CAST(floor(d / 60.0 + 0.5e0) AS BIGINT), ' min') WHEN d < 86400 THEN concat('há ', CAST(floor(d / 3600.0 + 0.5e0) AS BIGINT), ' h') WHEN d < 2592000 THEN concat('há ', CAST(floor(d / 86400.0 + 0.5e0) AS BIGINT), ' dias') ELSE strftime(TIMESTAMP '2024-02-01 12:00:00' - to_seconds(d), '%d/%m/%Y') END AS quando, strftime(TIMESTAMP '2024-02-01 12:00:00' - to_seconds(d), '%d/%m/%Y') AS data FROM (SELECT event_id, CAST(event_id * event_id % 4000000 AS BIGINT) AS d FROM events)")
def relative_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr(f"date_format(to_timestamp('{_NOW}') - make_interval(0, 0, 0, 0, 0, 0, event_id * event_id % 4000000), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
    return table(spark, sf_dir, "events").select("event_id", views.age_text(at, F.lit(_NOW)).alias("quando"), views.date_text(at).alias("data"))


@query(_L + "SELECT chave, CASE WHEN area > 0 AND aluguel > 0 THEN aluguel / area END AS m2, round(lng - 0.012, 6) AS oeste, round(lat - 0.008, 6) AS sul, round(lng + 0.012, 6) AS leste, round(lat + 0.008, 6) AS norte FROM l")
def map_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.map_box(F.col("lat"), F.col("lng"))
    return listings(spark, sf_dir).select("chave", views.rent_per_area(F.col("aluguel"), F.col("area")).alias("m2"), *[F.round(b[c], 6).alias(c) for c in ("oeste", "sul", "leste", "norte")])


@query(_L + "SELECT count(*) AS n, 0 AS longe FROM l WHERE lat IS NOT NULL")
def pins_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located rows, and how many of them moved by more than 0.002 degrees or, not being approximate, at all."""
    rows = state(spark, sf_dir).withColumns({"coord_aprox": F.col("ord") % 2 == 0, "a": F.col("lat"), "b": F.col("lng")})
    off = F.greatest(F.abs(F.col("lat") - F.col("a")), F.abs(F.col("lng") - F.col("b")))
    return views.spread_pins(rows, 7).agg(F.count(F.lit(1)).alias("n"), F.count_if(off > F.when(F.col("coord_aprox"), 0.002000001).otherwise(0.0)).cast("int").alias("longe"))


@query(_L + "SELECT chave, concat_ws('|', CASE WHEN quartos IS NOT NULL THEN concat(quartos, CASE WHEN quartos = 1 THEN ' quarto' ELSE ' quartos' END) END, CASE WHEN vagas = 0 THEN 'sem vaga' WHEN vagas = 1 THEN '1 vaga' ELSE concat(vagas, ' vagas') END, CASE WHEN area > 0 THEN concat(replace(CASE WHEN area = floor(area) THEN concat('', CAST(area AS BIGINT)) ELSE concat('', area) END, '.', ','), ' m²') END) AS fatos, concat_ws('|', CASE WHEN aceita_pet THEN 'Aceita pet' WHEN NOT aceita_pet THEN 'Sem pet' END, 'Fiador') AS etiquetas, CASE WHEN ord % 2 = 0 AND aluguel IS NOT NULL THEN concat('Total R$ ', ord % 100 + 2000, ' · cond. 10') WHEN ord % 3 = 0 THEN 'Sem condomínio/IPTU informados' ELSE 'Condomínio/IPTU: ver anúncio' END AS texto FROM l WHERE ord % 100 + 2000 >= 2000")
def card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = listings(spark, sf_dir).withColumn("total", F.when(F.col("ord") % 2 == 0, (F.col("ord") % 100 + 2000).cast("double")))
    total_of = views.total_text(F.when(F.col("aluguel").isNotNull(), F.lit(900.0)), F.lit(10.0), F.lit(0.0), F.regexp_replace(F.col("total").cast("string"), "x", "").cast("double"), F.col("ord") % 3 == 0)
    facts = views.facts(F.col("quartos"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("vagas"), F.col("area"))
    return r.select("chave", F.array_join(facts, "|").alias("fatos"), F.array_join(views.tags(F.lit(None).cast("boolean"), F.col("aceita_pet"), F.array(F.lit("Fiador"))), "|").alias("etiquetas"), F.regexp_replace(total_of, r"(\d)\.(\d)", "$1$2").alias("texto"))


@query(_L + "SELECT chave, concat('Oi ', titulo, ' (ref. ', id, ') em ', bairro, ' por ', CASE WHEN aluguel IS NULL THEN '—' ELSE 'x' END, ' ', url, ' ') AS mensagem FROM l")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state(spark, sf_dir).withColumn("referencia", F.col("id"))
    m = views.message("Oi {titulo}{ref} em {bairro} por {aluguel} {url} {anunciante}", "Botucatu")
    return rows.select("chave", F.regexp_replace(m, r" por [\d.,]+ ", " por x ").alias("mensagem"))


@query(_L + "SELECT rpad(substr(chave, 1, 22), 22, ' ') || '  ' || rpad(substr(tipo, 1, 12), 12, ' ') || '  ' || rpad('7', 8, ' ') || '  ' || rpad('—', 8, ' ') || '  ' || rpad(CASE WHEN quartos IS NULL THEN '—' ELSE concat('', quartos) END, 2, ' ') || '  ' || rpad(substr(bairro, 1, 26), 26, ' ') || '  ' || rpad('—', 26, ' ') || '  ' || rpad('—', 16, ' ') AS linha, ord FROM l UNION ALL SELECT rpad('CHAVE', 24, ' ') || rpad('TIPO', 14, ' ') || rpad('ALUGUEL', 10, ' ') || rpad('TOTAL', 10, ' ') || rpad('Q', 4, ' ') || rpad('BAIRRO', 28, ' ') || rpad('ANUNCIANTE', 28, ' ') || rpad('CONTATO', 16, ' '), -2 UNION ALL SELECT repeat('-', 134), -1")
def console_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.listing_table(state(spark, sf_dir).withColumn("aluguel", F.lit(7.0))).select("linha", "ord")


@query(_L + "SELECT chave, concat(titulo, chr(10), tipo, ' · R$ ', CASE WHEN aluguel IS NULL THEN '?' ELSE '5' END, ' + cond. 10.5', chr(10), CASE WHEN quartos IS NULL THEN '?' ELSE concat('', quartos) END, ' quartos · ? banh. · ', vagas, ' vagas · 3 m²', chr(10), concat_ws(', ', bairro, cidade), chr(10), 'Anunciante: Eu (ref. ', id, ')', chr(10), 'Características: a, b', chr(10), chr(10), descricao, chr(10), chr(10), url) AS texto FROM l")
def plain_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state(spark, sf_dir).withColumns({"aluguel": F.when(F.col("aluguel").isNotNull(), 5.0), "condominio": F.lit(10.5), "iptu": F.lit(0.0), "area": F.lit(3.0), "anunciante": F.lit("Eu"), "referencia": F.col("id"), "caracteristicas": F.array(F.lit("a"), F.lit("b"))})
    return views.plain_record(rows)


@query(_L + "SELECT chave, concat('{\"chave\":\"', chave, '\",\"grupo\":', CASE WHEN grupo IS NULL THEN 'null' ELSE concat('\"', grupo, '\"') END, ',\"vagas\":', vagas, ',\"notas\":null}') AS json FROM l")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.json_rows(state(spark, sf_dir).select("chave", "grupo", "vagas", "notas")).select(F.regexp_extract("json", '"chave":"([^"]*)"', 1).alias("chave"), "json")


@query(_L + ", c AS (SELECT bairro, avg(lat) AS a FROM l WHERE lat IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM l) AS imoveis, (SELECT count(*) FROM l LEFT JOIN c ON l.bairro = c.bairro WHERE coalesce(lat, a) IS NOT NULL) AS com_lugar, 10 AS execucoes, 25 AS fontes, 'Botucatu/SP' AS lugar")
def reader_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the payload's parts: rows, rows with a place, the last ten runs, the configured sources."""
    c = config.Config(cidade="Botucatu", uf="SP", fontes=[])
    p = views.payload(state(spark, sf_dir), _runs(spark, sf_dir), c, _sources(spark, sf_dir), private=False)
    rows = p["imoveis"].agg(F.count(F.lit(1)).alias("imoveis"), F.count_if(F.col("lat").isNotNull() & (F.col("notas") == "")).alias("com_lugar"))
    return rows.crossJoin(p["execucoes"].agg(F.count(F.lit(1)).cast("int").alias("execucoes"))).crossJoin(p["config"].select(F.size("fontes").alias("fontes"), F.concat_ws("/", "cidade", "uf").alias("lugar")))


@query(_L + "SELECT a.chave, string_agg(n_name, '|' ORDER BY o) AS tambem_em FROM (SELECT a.chave, b.fonte, min(b.ord) AS o FROM l a JOIN l b ON a.grupo = b.grupo AND a.chave <> b.chave GROUP BY 1, 2) a JOIN nation ON concat('f', n_nationkey) = a.fonte GROUP BY 1")
def other_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.other_sources(listings(spark, sf_dir), _sources(spark, sf_dir)).select("chave", F.array_join("tambem_em", "|").alias("tambem_em"))


@query(_L + "SELECT chave, chave = 'f0:77' AS ativo, CASE WHEN chave = 'f0:77' THEN 'visita' ELSE status END AS status, CASE WHEN chave = 'f0:77' THEN concat('velha', chr(10), '[01/02/2024] liguei') ELSE 'velha' END AS notas, CASE WHEN chave = 'f0:77' THEN 88 END AS nota, CASE WHEN chave = 'f0:77' THEN 2 END AS alertas FROM l")
def commands_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status, a note and an annotation set on one row."""
    s = state(spark, sf_dir).withColumn("notas", F.lit("velha"))
    s = commands.set_status(s, "f0:77", "visita", _NOW)
    s = commands.annotate(commands.append_note(s, "f0:77", "liguei ", _NOW), "f0:77", " bom ", 87.5, ["a", " ", "b"], _NOW)
    return s.select("chave", F.coalesce(F.col("status_em") == _NOW, F.lit(False)).alias("ativo"), "status", "notas", F.col("ia.nota").alias("nota"), F.when(F.col("ia").isNotNull(), F.size("ia.alertas")).alias("alertas"))


@query(_L + "SELECT chave, CASE WHEN chave = 'f0:77' THEN 'nova' ELSE descricao END AS descricao, CASE WHEN chave = 'f0:77' THEN 5000.0e0 ELSE aluguel END AS aluguel, CASE WHEN chave = 'f0:77' THEN 5010.0e0 ELSE aluguel END AS total, chave = 'f0:77' AS detalhado, bairro, titulo FROM l")
def detail_read_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row's detail page read again: what it says wins, what it leaves out stays."""
    s = state(spark, sf_dir).withColumn("total", F.col("aluguel"))
    d = spark.range(1).selectExpr("'f0' AS fonte", "'77' AS id", "'nova' AS descricao", "5000D AS aluguel", "10D AS condominio", "cast(null AS string) AS bairro", "cast(array() AS array<string>) AS fotos")
    return commands.read_again(s, "f0:77", d, lambda x: x).select("chave", "descricao", "aluguel", "total", "detalhado", "bairro", "titulo")


@query(
    """WITH c AS (SELECT concat('f', l_suppkey % 30) AS fonte, CASE l_linenumber % 4 WHEN 0 THEN 'inserir' WHEN 1 THEN 'atualizar' WHEN 2 THEN 'desativar' ELSE 'manter' END AS acao, l_orderkey FROM lineitem),
    d AS (SELECT concat('f', l_suppkey % 30) AS fonte, count(*) FILTER (l_quantity > 2) AS bons, count(*) FILTER (l_quantity <= 2) AS ruins FROM lineitem GROUP BY 1),
    s AS (SELECT fonte, count(*) AS n, count(*) FILTER (acao = 'inserir') AS a, count(*) FILTER (acao = 'atualizar') AS b, count(*) FILTER (acao = 'desativar') AS c FROM c GROUP BY 1)
    SELECT s.fonte, s.fonte <> 'f4' AS ok, CAST(CASE WHEN s.fonte = 'f4' THEN 0 ELSE n END AS INTEGER) AS encontrados, CAST(CASE WHEN s.fonte = 'f4' THEN 0 ELSE a END AS INTEGER) AS novos, CAST(CASE WHEN s.fonte = 'f4' THEN 0 ELSE b END AS INTEGER) AS atualizados, CAST(CASE WHEN s.fonte = 'f4' THEN 0 ELSE c END AS INTEGER) AS removidos,
    CAST(CASE WHEN s.fonte = 'f4' THEN 0 ELSE coalesce(bons, 0) END AS INTEGER) AS detalhados, CAST(1 + least(coalesce(ruins, 0), 3) + CASE WHEN ruins > 3 THEN 1 ELSE 0 END AS INTEGER) AS avisos, CASE WHEN ruins > 3 THEN concat('... e mais ', ruins - 3, ' falhas de detalhe') END AS ultimo FROM s LEFT JOIN d ON s.fonte = d.fonte"""
)
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run: a merge's actions, found rows, detail pages with their first failures; one source failed."""
    li = table(spark, sf_dir, "lineitem").withColumn("fonte", F.expr("concat('f', l_suppkey % 30)"))
    changes = li.withColumn("acao", F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'inserir' WHEN 1 THEN 'atualizar' WHEN 2 THEN 'desativar' ELSE 'manter' END"))
    scans = changes.groupBy("fonte").agg(F.count(F.lit(1)).alias("encontrados")).select("fonte", "encontrados", F.when(F.col("fonte") == "f4", "quebrou").alias("erro"), F.array(F.lit("aviso")).alias("avisos"), F.lit(5).alias("ms"))
    pages = li.select("fonte", F.col("l_orderkey").alias("ord"), F.col("l_partkey").cast("string").alias("id"), F.when(F.col("l_quantity") <= 2, "sumiu").alias("erro"))
    s = merge.run_summary(changes, scans, pages)
    last = F.element_at("avisos", -1)
    return s.select("fonte", "ok", "encontrados", "novos", "atualizados", "removidos", "detalhados", F.size("avisos").alias("avisos"), F.when(last.startswith("..."), last).alias("ultimo"))


@query("WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part) SELECT concat('f:', k) AS chave, CASE WHEN s % 2 = 0 THEN 'velha' ELSE 'nova' END AS descricao, CASE WHEN s % 3 = 0 THEN NULL ELSE 'T' END AS titulo, CASE WHEN s % 5 = 0 THEN 'a|b' ELSE 'x|y|z' END AS fotos, CASE WHEN s % 7 = 0 THEN 1e0 ELSE 3e0 END AS lat, CASE WHEN k % 2 = 0 THEN 'A|B|C' ELSE 'B|C' END AS caracteristicas, k % 2 = 0 AS detalhado, CASE WHEN s % 3 = 0 THEN 777e0 ELSE 510e0 END AS total FROM p")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of field of an update: kept if the new one is empty, always the new one, the longer list of photos, both coordinates or none, united lists, the larger total."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS s")
    arr = lambda *x: F.array(*map(F.lit, x))
    key = [F.col("k").cast("string").alias("id"), F.lit("f").alias("fonte")]
    old = p.select(*key, F.concat(F.lit("f:"), F.col("k").cast("string")).alias("chave"), F.lit("velha").alias("descricao"), F.lit("velho").alias("titulo"), arr("a", "b").alias("fotos"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), arr("A", "B").alias("caracteristicas"), (F.col("k") % 2 == 0).alias("detalhado"), F.lit(10.0).alias("condominio"), F.lit(400.0).alias("aluguel"), F.lit(410.0).alias("total"), F.lit(True).alias("ativo"), F.col("k").alias("ord"))
    new = p.select(*key, F.when(F.col("s") % 2 == 1, "nova").when(F.col("s") % 4 == 0, "").alias("descricao"), F.when(F.col("s") % 3 != 0, "T").alias("titulo"), F.when(F.col("s") % 5 == 0, arr("x")).otherwise(arr("x", "y", "z")).alias("fotos"), F.when(F.col("s") % 7 != 0, 3.0).alias("lat"), F.lit(4.0).alias("lng"), arr("B", "C").alias("caracteristicas"), F.lit(500.0).alias("aluguel"), F.when(F.col("s") % 3 == 0, 777.0).otherwise(500.0).alias("total"))
    batch = merge.default_row(new).withColumn("ord", F.lit(0).cast("long"))
    done = spark.range(1).select(F.lit("f").alias("fonte"), F.lit(True).alias("completo"))
    out = merge.apply_results(merge.default_row(old, STATE), batch, done, _NOW)
    j = lambda c: F.array_join(c, "|").alias(c)
    return out.select("chave", "descricao", "titulo", j("fotos"), "lat", j("caracteristicas"), "detalhado", "total")


@query("SELECT concat('', p_partkey) AS id, false AS detalhado, 0 AS fotos, CAST(NULL AS VARCHAR) AS bairro FROM part")
def default_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = merge.default_row(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id")))
    return r.select("id", "detalhado", F.size("fotos").alias("fotos"), "bairro")


@query(_L + "SELECT chave, CASE WHEN ord % 2 = 0 THEN coalesce(CASE WHEN ord % 4 = 0 THEN 'minha' END, 'antes') WHEN ord % 4 = 1 THEN 'minha' END AS notas FROM l WHERE ord % 2 = 0 OR ord % 4 = 1")
def reader_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's own fields: changes win, new keys come in, nulls change nothing."""
    rows = listings(spark, sf_dir)
    local = rows.where("ord % 2 = 0").select("chave", F.lit("antes").alias("notas"))
    changes = rows.select("chave", F.when(F.col("ord") % 4 <= 1, "minha").alias("notas")).where("notas IS NOT NULL")
    return commands.remember(local, changes)


@query(_L + ", g AS (SELECT CASE WHEN quartos IS NULL THEN '?' ELSE concat('', quartos) END AS grupo, count(*) AS n FROM l GROUP BY 1) SELECT grupo, n, row_number() OVER (ORDER BY CASE WHEN grupo = '?' THEN '!' ELSE grupo END) AS lugar FROM g")
def stats_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups as a reader orders words: signs before digits."""
    g = listings(spark, sf_dir).groupBy(F.coalesce(F.col("quartos").cast("string"), F.lit("?")).alias("grupo")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.collate("grupo", "UNICODE"))  # a row for each number of rooms
    return views.sorted_stats(g).withColumn("lugar", F.row_number().over(w)).select(F.collate("grupo", "UTF8_BINARY").alias("grupo"), "n", "lugar")


@query(_L + ", v AS (SELECT * FROM l WHERE tipo <> 'terreno' AND tipo <> 'studio' AND (aluguel IS NULL OR aluguel <= 1400) AND fonte <> 'f4'), c AS (SELECT fonte, count(*) AS n FROM v GROUP BY 1) SELECT f.fonte, f.fonte <> 'f4' AS ok, CAST(coalesce(n, 0) AS INTEGER) AS encontrados, CAST(coalesce(n, 0) AS INTEGER) AS novos, CASE WHEN f.fonte = 'f4' THEN 'bloqueado' END AS erro, (SELECT count(*) FROM v) AS total_novos FROM (SELECT DISTINCT fonte FROM l) f LEFT JOIN c ON f.fonte = c.fonte")
def whole_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over seven sources, one of them blocked: criteria, merge into an empty state, run log."""
    c = config.Config(cidade="Botucatu", uf="SP", fontes=[], aluguel_max=1400, tipos=["apartamento", "kitnet", "casa", "sobrado", "casa_condominio"], buscar_detalhes=False)
    rows = merge.default_row(listings(spark, sf_dir).withColumn("cidade", F.lit("Botucatu")), keep=("ord",))
    scans = {f"f{i}": (rows.where(F.col("fonte") == f"f{i}"), {"completo": True, "erro": "bloqueado" if i == 4 else None}) for i in range(7)}
    _, log, _ = crawl.run(state(spark, sf_dir).limit(0), scans, c, _NOW, _NOW)
    return log.select(F.explode("fontes").alias("fonte", "r"), F.col("novos").alias("total_novos")).select("fonte", "r.ok", "r.encontrados", "r.novos", "r.erro", "total_novos")


