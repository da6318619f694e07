"""Read views: statistics, summary, centroids, contacts, compact rows, group members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import stat_family, type_label
from ..functions.text import bind, half_up, normalize_bairro, plain_number
from ..sources.shared import stored
from .criteria import first_per_group
from .merge import last_n, last_run
from .quantiles import exact_quantiles


def market_stats(state: DataFrame, store: Callable[[DataFrame], DataFrame] = lambda df: stored(df, "stats")) -> DataFrame:
    """(grupo, n, p25, mediana, p75, mediana_m2) of active listings, one of each duplicate group."""
    rows = first_per_group(state.where("ativo AND aluguel IS NOT NULL"), [F.col("ord")])
    rooms = F.when(F.col("quartos").isNull(), "?").when(F.col("quartos") >= 3, "3+").otherwise(F.col("quartos").cast("string"))
    m2 = F.when(F.col("area") > 5, F.col("aluguel") / F.col("area"))
    group = F.concat(stat_family(F.col("tipo")), F.lit(" · "), rooms, F.lit(" quartos")).alias("grupo")
    both = F.array(F.struct(F.lit("aluguel").alias("medida"), F.col("aluguel").alias("x")), F.struct(F.lit("m2").alias("medida"), m2.alias("x")))
    found = exact_quantiles(rows.select(group, F.inline(both)), ["grupo", "medida"], "x", [0.25, 0.5, 0.75], store)
    q = lambda of, p: F.max(F.when((F.col("medida") == of) & (F.col("p") == p), half_up(F.round("q", 8), 2)))  # noqa: E731  interpolation noise must not decide a half
    n = F.max(F.when(F.col("medida") == "aluguel", F.col("n"))).alias("n")
    return found.groupBy("grupo").agg(n, q("aluguel", 0.25).alias("p25"), q("aluguel", 0.5).alias("mediana"), q("aluguel", 0.75).alias("p75"), q("m2", 0.5).alias("mediana_m2"))


def sorted_stats(stats: DataFrame) -> DataFrame:
    """Statistics by their group's name, as a reader orders words."""
    return stats.orderBy(F.collate("grupo", "UNICODE"))


def summary(state: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row: totals, actives, unannotated, groups; counts of active rows by status and source as maps; the last run."""
    unread = F.col("ativo") & F.col("ia").isNull() & (F.col("status") != "descartado")
    base = state.agg(F.count(F.lit(1)).alias("total"), F.count_if("ativo").alias("ativos"), F.count_if(unread).alias("sem_ia"), F.count_distinct(F.when(F.col("ativo"), F.nullif("grupo", F.lit("")))).alias("grupos"))
    as_map = lambda df, k, name: df.groupBy(k).agg(F.count(F.lit(1)).alias("c")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k), "c")))).alias(name))  # noqa: E731  a row for each status or source
    out = base.crossJoin(as_map(state.where("ativo"), "status", "por_status")).crossJoin(as_map(state.where("ativo"), "fonte", "por_fonte"))
    if runs is None:
        return out
    last = last_run(runs).agg(F.first(F.struct("inicio", "fim", "novos")).alias("ultima_busca"))  # one row, null without runs
    return out.crossJoin(last)


def header(state: DataFrame, runs: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: active rows, when the last run ended, names of its failed sources, and names of the sources that have rows, in catalogue order."""
    active = state.agg(F.count_if("ativo").alias("ativos"))
    listed = lambda df: F.transform(F.array_sort(F.collect_list(F.struct("pos", "nome"))), lambda x: x["nome"])
    used = sources.join(state.select(F.col("fonte").alias("id")).distinct(), "id", "left_semi").agg(listed(sources).alias("usadas"))
    run = last_run(runs)
    when = run.agg(F.first(F.coalesce("fim", "inicio")).alias("ultima"))
    failed = run.select(F.explode("fontes").alias("id", "r")).where("NOT r.ok").join(sources, "id", "left").select(F.coalesce("pos", F.lit(1 << 30)).alias("pos"), F.coalesce("nome", "id").alias("nome")).agg(listed(sources).alias("falhas"))
    return active.crossJoin(when).crossJoin(failed).crossJoin(used)


def public_config(config, sources: DataFrame) -> DataFrame:
    """One row: the part of a configuration that readers see."""
    f = sources.select("pos", F.struct("id", "nome", "plataforma", "url", "ativo", "aviso").alias("f")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "f"))), lambda x: x["f"]).alias("fontes"))
    links = F.array(*[F.struct(*[F.lit(x.get(k)).cast("string").alias(k) for k in ("nome", "url", "obs")]) for x in config.links_manuais]).cast("array<struct<nome:string,url:string,obs:string>>")
    return f.select(F.lit(config.cidade).alias("cidade"), F.lit(config.uf).alias("uf"), F.lit(float(config.aluguel_max)).alias("aluguel_max"), F.array(*map(F.lit, config.tipos)).alias("tipos"), F.lit(config.quartos_min).alias("quartos_min"), F.lit(config.mensagem).alias("mensagem_whatsapp"), "fontes", links.alias("busca_manual"))


def payload(state: DataFrame, runs: DataFrame, config, sources: DataFrame, private: bool = True) -> dict[str, DataFrame]:
    """What a reader's page loads: configuration, rows with coordinates filled (notes blank unless ``private``), the last ten runs.

    The parts stay tables; ``export`` writes each where it is, so no part is gathered in one place.
    """
    rows = with_coordinates(state)
    runs10 = last_n(runs.withColumn("_all", F.lit(0)), ["_all"], [F.desc("inicio")], 10).drop("_all")  # the log holds 50 runs at most
    return {"config": public_config(config, sources), "imoveis": rows if private else rows.withColumn("notas", F.lit("")), "execucoes": runs10.orderBy("inicio")}


def centroids(rows: DataFrame) -> DataFrame:
    """(bairro_norm, c_lat, c_lng): mean coordinates of a neighbourhood over all rows, inactive too."""
    b = normalize_bairro(F.col("bairro"))
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").select(b.alias("bairro_norm"), "lat", "lng").where("bairro_norm <> ''").groupBy("bairro_norm").agg(F.avg("lat").alias("c_lat"), F.avg("lng").alias("c_lng"))


def with_coordinates(rows: DataFrame) -> DataFrame:
    """Rows without coordinates get their neighbourhood's, marked approximate; nothing is stored."""
    lacking = F.col("lat").isNull() | F.col("lng").isNull()
    j = rows.withColumn("bairro_norm", F.nullif(normalize_bairro(F.col("bairro")), F.lit(""))).join(centroids(rows), "bairro_norm", "left")
    fill = lacking & F.col("c_lat").isNotNull()
    return j.withColumns({"coord_aprox": F.when(fill, True).otherwise(F.col("coord_aprox")), "lat": F.when(fill, F.col("c_lat")).otherwise(F.col("lat")), "lng": F.when(fill, F.col("c_lng")).otherwise(F.col("lng"))}).select(*rows.columns)


def best_contact(contacts: Column, fall_back: bool = True) -> Column:
    """A broker with WhatsApp, else anyone with it, else anyone with a phone, else the first (or null)."""
    first = lambda f: F.get(F.filter(contacts, f), F.lit(0))
    picks = [first(lambda c: (c["papel"] == "corretor") & c["whatsapp"].isNotNull()), first(lambda c: c["whatsapp"].isNotNull()), first(lambda c: c["telefone"].isNotNull())]
    return F.coalesce(*picks, *([F.get(contacts, F.lit(0))] if fall_back else []))


def group_members(state: DataFrame) -> DataFrame:
    """(chave, outros): the other members of a row's group, in stored order. Groups hold one row a source at most."""
    m = state.where("grupo IS NOT NULL").groupBy("grupo").agg(F.array_sort(F.collect_list(F.struct("ord", "chave", "fonte", "url", "aluguel"))).alias("todos"))
    return state.where("grupo IS NOT NULL").select("chave", "grupo").join(m, "grupo").select("chave", F.filter("todos", lambda x: x["chave"] != F.col("chave")).alias("outros"))


def facts(rooms: Column, suites: Column, baths: Column, parking: Column, area: Column) -> Column:
    """Short facts of a card, unknown ones left out."""
    count = lambda c, one, more: F.concat(c.cast("string"), F.lit(" "), F.when(c == 1, one).otherwise(more))
    size = F.concat(plain_number(area), F.lit(" m²"))
    return F.array_compact(F.array(count(rooms, "quarto", "quartos"), F.when(suites > 0, count(suites, "suíte", "suítes")), count(baths, "banh.", "banh."), F.when(parking == 0, "sem vaga").otherwise(count(parking, "vaga", "vagas")), F.when(area != 0, size)))


def tags(furnished: Column, pet: Column, guarantees: Column) -> Column:
    """Labels of a card."""
    lead = F.array_compact(F.array(F.when(furnished, "Mobiliado"), F.when(pet, "Aceita pet").when(~pet, "Sem pet")))
    return F.concat(lead, F.coalesce(guarantees, F.array().cast("array<string>")))


def compact(state: DataFrame, text: int = 700, notes: int = 400) -> DataFrame:
    """The result row of a query: short text, last notes, best contact, where else it is offered."""
    long_notes, long_text = F.length("notas") > notes, F.length("descricao") > text
    rows = state.join(group_members(state), "chave", "left")
    return rows.select("chave", "fonte", "url", "titulo", "tipo", "aluguel", "condominio", "iptu", "total", "quartos", "banheiros", "vagas", "area", "bairro", "cidade", "status", "ativo", "primeira_vez", "mobiliado", "aceita_pet", "garantias", best_contact(F.col("contatos")).alias("contato"), F.when(long_text, F.concat(F.substring("descricao", 1, text), F.lit("…"))).otherwise(F.col("descricao")).alias("descricao"), F.when(long_notes, F.concat(F.lit("…"), F.right("notas", F.lit(notes)))).otherwise(F.col("notas")).alias("notas"), F.transform(F.coalesce("outros", F.array().cast("array<struct<ord:bigint,chave:string,fonte:string,url:string,aluguel:double>>")), lambda x: F.concat_ws(":", x["fonte"], x["url"])).alias("tambem_em"), "ia", "anunciante", "status_em", "grupo")


def text_table(df: DataFrame, widths: dict[str, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """One fixed-width line a row; columns in ``keep`` stay."""
    return df.select(F.concat_ws("  ", *[F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, w), w, " ") for c, w in widths.items()]).alias("linha"), *keep)


def other_sources(state: DataFrame, sources: DataFrame) -> DataFrame:
    """(chave, tambem_em): distinct names of the sources of a row's other group members, in stored order; an unknown source by its id."""
    named = group_members(state).select("chave", F.posexplode("outros").alias("at", "o")).select("chave", "at", F.col("o.fonte").alias("id")).join(sources.select("id", "nome"), "id", "left")
    lists = named.groupBy("chave").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("nome", "id").alias("nome")))).alias("x"))
    return lists.select("chave", F.array_distinct(F.transform("x", lambda v: v["nome"])).alias("tambem_em"))


def named_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with ``fonte_nome``: the source's name, or its id where the catalogue lacks it."""
    return rows.join(sources.select(F.col("id").alias("fonte"), F.col("nome").alias("_nome")), "fonte", "left").withColumn("fonte_nome", F.coalesce("_nome", "fonte")).drop("_nome")


def rent_per_area(rent: Column, area: Column) -> Column:
    """Rent by the square metre where both are known and not zero."""
    return F.when((area != 0) & (rent != 0), rent / area)


def total_text(rent: Column, condo: Column, tax: Column, total: Column, detailed: Column) -> Column:
    """The line under a card's price."""
    some = lambda c, label: F.when(c != 0, F.concat(F.lit(f"{label} "), plain_number(c)))
    parts = F.array_join(F.array_compact(F.array(some(condo, "cond."), some(tax, "IPTU"))), " · ")
    more = F.concat(F.lit("Total R$ "), plain_number(total), F.lit(" · "), F.coalesce(F.nullif(parts, F.lit("")), F.lit("com taxas")))
    return F.when(total > rent, more).when(detailed, "Sem condomínio/IPTU informados").otherwise("Condomínio/IPTU: ver anúncio")


def age_text(at: Column, now: Column) -> Column:
    """How long ago an instant was, for a reader: minutes, hours, days, or its date after thirty days; a dash for none."""
    t = at.try_cast("timestamp")

    def whole(d: Column) -> Column:
        n = lambda unit: F.floor(d / unit + 0.5).cast("long").cast("string")
        return (
            F.when(d < 90, "agora há pouco")
            .when(d < 3600, F.concat(F.lit("há "), n(60), F.lit(" min")))
            .when(d < 86400, F.concat(F.lit("há "), n(3600), F.lit(" h")))
            .when(d < 86400 * 30, F.concat(F.lit("há "), n(86400), F.lit(" dias")))
        )

    gone = (F.unix_millis(now.try_cast("timestamp")) - F.unix_millis(t)) / 1000.0
    return F.coalesce(bind(gone, whole), F.date_format(t, "dd/MM/yyyy"), F.lit("—"))


def date_text(at: Column) -> Column:
    """Day, month and year; a dash for none."""
    return F.coalesce(F.date_format(at.try_cast("timestamp"), "dd/MM/yyyy"), F.lit("—"))


def map_box(lat: Column, lng: Column) -> Column:
    """Bounds of the small map around a place: (west, south, east, north)."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct((lng - 0.012).alias("oeste"), (lat - 0.008).alias("sul"), (lng + 0.012).alias("leste"), (lat + 0.008).alias("norte")))


def spread_pins(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Rows on the map; those at a neighbourhood's centre moved by up to 0.002 degrees so that pins do not hide each other. For display only."""
    moved = lambda c, s: F.when(F.coalesce("coord_aprox", F.lit(False)), F.col(c) + (F.rand(seed + s) - 0.5) * 0.004).otherwise(F.col(c))
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").withColumns({"lat": moved("lat", 0), "lng": moved("lng", 1)})


#: Headings and widths of the console's table of listings (fixed values).
LISTING_TABLE = {"CHAVE": 22, "TIPO": 12, "ALUGUEL": 8, "TOTAL": 8, "Q": 2, "BAIRRO": 26, "ANUNCIANTE": 26, "CONTATO": 16}


def listing_table(rows: DataFrame) -> DataFrame:
    """(linha, ord): the console's table of eight columns, heading and rule first; "(nenhum)" without rows."""
    dash = F.lit("—")
    money = lambda c: F.coalesce(plain_number(F.col(c)), dash)
    cells = [F.col("chave"), F.col("tipo"), money("aluguel"), money("total"), F.coalesce(F.col("quartos").cast("string"), dash), F.coalesce("bairro", dash), F.coalesce("anunciante", dash), F.coalesce(best_contact(F.col("contatos"))["telefone"], dash)]
    body = text_table(rows.select(*[c.alias(n) for c, n in zip(cells, LISTING_TABLE, strict=True)], F.col("ord").cast("long").alias("ord")), LISTING_TABLE, keep=("ord",))
    head = "  ".join(n[:w].ljust(w) for n, w in LISTING_TABLE.items())
    rule = "-" * (sum(w + 2 for w in LISTING_TABLE.values()) - 2)
    spark = rows.sparkSession
    first = spark.range(1).select(F.inline(F.array(F.struct(F.lit(head).alias("linha"), F.lit(-2).cast("long").alias("ord")), F.struct(F.lit(rule).alias("linha"), F.lit(-1).cast("long").alias("ord")))))
    some = rows.limit(1).select(F.lit(1).alias("_some"))
    full = first.crossJoin(F.broadcast(some)).drop("_some").unionByName(body)
    empty = spark.range(1).select(F.lit("(nenhum)").alias("linha"), F.lit(0).cast("long").alias("ord"), F.lit(1).alias("_k")).join(F.broadcast(some.select(F.col("_some").alias("_k"))), "_k", "left_anti").drop("_k")
    return full.unionByName(empty)


def plain_record(rows: DataFrame) -> DataFrame:
    """(chave, texto): each listing as lines of text, unknown values as question marks, empty lines left out."""
    q = lambda c: F.coalesce(number_text(F.col(c)), F.lit("?"))
    plus = lambda c, label: F.when(F.col(c) != 0, F.concat(F.lit(label), number_text(F.col(c)))).otherwise("")
    some = lambda c, *parts: F.when(F.coalesce(c != "", F.lit(False)), F.concat(*parts))
    word = lambda c: F.coalesce(c, F.lit(""))
    price = F.concat(F.coalesce("tipo", F.lit("?")), F.lit(" · R$ "), q("aluguel"), plus("condominio", " + cond. "), plus("iptu", " + IPTU "), plus("total", " = "))
    size = F.concat(q("quartos"), F.lit(" quartos · "), q("banheiros"), F.lit(" banh. · "), q("vagas"), F.lit(" vagas · "), q("area"), F.lit(" m²"))
    where = F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("endereco", "bairro", "cidade")])
    owner = some(F.col("anunciante"), F.lit("Anunciante: "), F.col("anunciante"), F.coalesce(some(F.col("referencia"), F.lit(" (ref. "), F.col("referencia"), F.lit(")")), F.lit("")))
    person = lambda c: F.concat(F.lit("Contato: "), word(c["nome"]), F.lit(" ["), c["papel"], F.lit("] "), word(c["telefone"]), F.coalesce(F.concat(F.lit(" wa.me/"), c["whatsapp"]), F.lit("")), F.lit(" "), word(c["email"]), F.coalesce(F.concat(F.lit(" CRECI "), c["creci"]), F.lit("")))
    features = F.when(F.size("caracteristicas") > 0, F.concat(F.lit("Características: "), F.array_join("caracteristicas", ", ")))
    lines = F.concat(F.array(F.col("titulo"), price, size, where, owner), F.transform("contatos", person), F.array(features, some(F.col("descricao"), F.lit("\n"), F.col("descricao")), F.concat(F.lit("\n"), word(F.col("url")))))
    return rows.select("chave", F.array_join(F.filter(lines, lambda x: x.isNotNull() & (x != "")), "\n").alias("texto"))


def number_text(c: Column) -> Column:
    """A number as scripts print it: whole ones without a point."""
    return F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))


def json_rows(rows: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def message(template: str, city: str) -> Column:
    """The text that a reader sends about a row, from the configured template."""
    from ..functions.text import fill_template

    ref = F.coalesce(F.concat(F.lit(" (ref. "), F.nullif("referencia", F.lit("")), F.lit(")")), F.lit(""))
    return fill_template(template or "Olá! Tenho interesse no imóvel {url}. Ainda está disponível?", titulo=F.coalesce(F.nullif("titulo", F.lit("")), type_label(F.col("tipo"))), ref=ref, bairro=F.coalesce(F.nullif("bairro", F.lit("")), F.lit(city)), aluguel=F.coalesce(plain_number(F.col("aluguel")), F.lit("—")), url=F.col("url"), anunciante=F.coalesce("anunciante", F.lit("")))


def extent(rows: DataFrame) -> DataFrame:
    """Bounds of the rows on the map and how many are located."""
    at = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    return rows.agg(*[f(F.when(at, F.col(c))).alias(f"{n}_{c}") for c in ("lat", "lng") for n, f in (("min", F.min), ("max", F.max))], F.count_if(at).alias("localizados"), F.count_if(~at).alias("sem_local"))
