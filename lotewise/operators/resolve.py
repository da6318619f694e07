"""Entity resolution: the same property in several sources becomes one group.

Candidate edges come from references and from equal attributes; a group never holds two listings
of one source. What counts is one pass over all edges in rank order through a union-find that refuses
to merge sets that share a source. ``constrained_sets`` has its result without that pass: unconstrained
components, formed by label propagation, do not touch each other, and inside one work goes in rounds. A
round strikes out every edge whose sets share a source (sets only grow, so it never can be used), replays a
component's least ``BATCH`` edges in one task, and merges every later edge that is the least at both of its
sets, which no other edge can come before. No task holds more than ``BATCH`` edges of a component.

Edges between equal attributes grow with the square of a group of copies, so ``attribute_sets`` has their
result from the listings: those that can meet at all are replayed together, and a listing looks for the next one
whose set shares no source with its own among sets of the same sources, not listing by listing.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import match_family
from ..functions.text import norm_ref, normalize_bairro, normalize_name
from ..schema import AGGREGATORS

#: What orders the edges, and how many of a component one task replays.
_RANK = ["stage", "r1", "r2", "r3"]
BATCH = 200_000
#: Listings that a task replays, unless those of one component are more.
ROWS = 50_000
#: What listings must have in common, beside areas that agree.
_SAME = ["aluguel", "familia", "b_norm", "quartos"]


def resolve_source(ads: DataFrame, sources: DataFrame) -> DataFrame:
    """(anunciante, fonte_resolvida): the first source whose name or nickname matches an advertiser's.

    Names match when equal, or when one holds the other and the held one has five characters;
    names under three characters never match, and aggregators are no targets.
    """
    names = sources.where(~F.col("plataforma").isin(*AGGREGATORS)).select("id", "pos", F.posexplode(F.concat(F.array("nome"), F.coalesce("apelidos", F.array().cast("array<string>")))).alias("at", "name")).withColumn("name", normalize_name(F.col("name"))).where(F.length("name") >= 3)
    who = ads.select("anunciante").distinct().withColumn("who", normalize_name(F.col("anunciante"))).where(F.length("who") >= 3)
    a, b = F.col("who"), F.col("name")
    ok = (a == b) | ((F.length(b) >= 5) & F.contains(a, b)) | ((F.length(a) >= 5) & F.contains(b, a))
    return who.join(names, ok).groupBy("anunciante").agg(F.min_by("id", F.struct("pos", "at")).alias("fonte_resolvida"))  # Spark broadcasts the catalogue, a config file, if it is small


def reference_edges(state: DataFrame, resolved: DataFrame) -> DataFrame:
    """(stage, r1, r2, r3, a, b): an aggregator's listing and the direct one with its source and reference."""
    active = state.where("ativo AND referencia IS NOT NULL AND referencia <> ''").withColumn("ref", norm_ref(F.col("referencia")))
    direct = active.where(~F.col("plataforma").isin(*AGGREGATORS)).groupBy("fonte", "ref").agg(F.max_by("chave", "ord").alias("b"))
    via = active.where(F.col("plataforma").isin(*AGGREGATORS)).join(resolved, "anunciante").select(F.col("chave").alias("a"), "ord", F.col("fonte_resolvida").alias("fonte"), "ref")
    return via.join(direct, ["fonte", "ref"]).select(F.lit(0).alias("stage"), F.col("ord").alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(0).cast("long").alias("r3"), "a", "b")


def areas_agree(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(2.0), F.lit(0.04) * F.greatest(a, b))


def equal_if_known(a: Column, b: Column) -> Column:
    return a.isNull() | b.isNull() | (a == b)


def _comparable(state: DataFrame) -> DataFrame:
    """The listings that attributes can match, and what they are matched by."""
    rows = state.where("ativo AND aluguel IS NOT NULL AND area IS NOT NULL AND quartos IS NOT NULL")
    return rows.select("chave", "fonte", "ord", "aluguel", match_family(F.col("tipo")).alias("familia"), normalize_bairro(F.col("bairro")).alias("b_norm"), "quartos", "area", "banheiros", "vagas", "condominio").where("b_norm <> ''")


def _leads(state: DataFrame) -> DataFrame:
    """(aluguel, r1): rents in the order of their first listings."""
    return state.where("ativo AND aluguel IS NOT NULL").groupBy("aluguel").agg(F.min("ord").alias("r1"))


def _paired(own: DataFrame) -> DataFrame:
    """The edges between comparable listings (with ``r1``)."""
    # areas that agree are one band apart at most: bands of 2 up to 50, of 4 % beyond, both a little wider
    band = F.floor(0.98 * F.when(F.col("area") <= 50, F.col("area") / 2).otherwise(25 + F.log(F.greatest(F.col("area"), F.lit(50.0)) / 50) / -math.log(0.96))).cast("int")
    own = own.withColumn("band", band)
    x, y = own.alias("x"), own.withColumn("band", F.explode(F.expr("array(band - 1, band, band + 1)"))).alias("y")
    cond = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in [*_SAME, "band"]]
    near = (F.col("x.ord") < F.col("y.ord")) & (F.col("x.fonte") != F.col("y.fonte")) & areas_agree(F.col("x.area"), F.col("y.area")) & equal_if_known(F.col("x.banheiros"), F.col("y.banheiros")) & equal_if_known(F.col("x.vagas"), F.col("y.vagas"))
    near &= F.col("x.condominio").isNull() | F.col("y.condominio").isNull() | (F.abs(F.col("x.condominio") - F.col("y.condominio")) <= 5)
    pairs = x.join(y, cond[0] & cond[1] & cond[2] & cond[3] & cond[4] & near)
    return pairs.select(F.lit(1).alias("stage"), F.col("x.r1").alias("r1"), F.col("x.ord").alias("r2"), F.col("y.ord").alias("r3"), F.col("x.chave").alias("a"), F.col("y.chave").alias("b"))


def attribute_edges(state: DataFrame) -> DataFrame:
    """Edges between listings of different sources that agree in rent, family, neighbourhood, rooms and size."""
    return _paired(_comparable(state).join(_leads(state), "aluguel"))


def label_components(edges: DataFrame, store) -> DataFrame:
    """(chave, comp): the least key that edges reach, by min-label propagation with pointer jumping.

    ``store`` writes a DataFrame where it survives lost executors.
    """
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:  # labels only fall, so a round that changes nothing comes
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("a").alias("comp"), F.col("comp").alias("far"))
        new = store(labels.join(near, "a").join(jump, "comp", "left").select("a", F.least("comp", "near", "far").alias("comp")))
        if new.join(labels.withColumnRenamed("comp", "old"), "a").where("comp <> old").isEmpty():
            return new.withColumnRenamed("a", "chave")
        labels = new


def replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, raiz): union-find over edges of sets in rank order; sets that share a source stay apart."""
    parent: dict[str, str] = {}
    sources: dict[str, set[str]] = {}

    def find(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    pdf = pdf.sort_values([*_RANK, "first", "second"])
    for a, b, fa, fb in zip(pdf["a"], pdf["b"], pdf["fa"], pdf["fb"], strict=True):
        for k, f in ((a, fa), (b, fb)):
            if k not in parent:
                parent[k], sources[k] = k, set(f)
        a, b = find(a), find(b)
        if a != b and not sources[a] & sources[b]:
            parent[b] = a
            sources[a] |= sources.pop(b)
    return pd.DataFrame([(k, find(k)) for k in parent], columns=["a", "raiz"])


def constrained_sets(edges: DataFrame, sources: DataFrame, store: Callable[[DataFrame], DataFrame], batch: int = BATCH, drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(chave, raiz) of every key with an edge: the sets of the pass in rank order.

    ``edges`` has stage, r1, r2, r3, a, b; ``sources`` (chave, fonte). ``store`` writes a DataFrame where it survives
    lost executors, ``drop`` deletes what no later round reads.
    """
    comp = label_components(edges, store)
    sets = store(comp.select("chave").join(sources, "chave").select("chave", F.col("chave").alias("raiz"), F.array("fonte").alias("fontes")))
    todo = store(edges.join(comp.withColumnRenamed("chave", "a"), "a").select("comp", *_RANK, F.col("a").alias("first"), F.col("b").alias("second"), "a", "b"))
    rank = F.struct(*_RANK, "first", "second")
    while True:
        held = sets.select("raiz", "fontes").distinct()  # a row for each set; all of its members have the same list
        side = lambda c: held.select(F.col("raiz").alias(c), F.col("fontes").alias(f"f{c}"))
        open_ = todo.where("a <> b").join(side("a"), "a").join(side("b"), "b").where(~F.arrays_overlap("fa", "fb"))
        pair = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
        live = store(open_.groupBy("comp", *pair).agg(F.min_by(F.struct(*_RANK, "first", "second", "a", "b", "fa", "fb"), rank).alias("e")).select("comp", "e.*"))
        if live.isEmpty():
            return sets.select("chave", "raiz")
        w = Window.partitionBy("comp").orderBy(*_RANK, "first", "second")
        first = live.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= batch).drop("_n")
        done = first.groupBy("comp").applyInPandas(replay, "a string, raiz string")
        large = live.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > batch).select("comp")
        rest = live.join(large, "comp")
        ends = rest.select("a", rank.alias("rank")).unionByName(rest.select(F.col("b").alias("a"), rank.alias("rank"))).groupBy("a").agg(F.min("rank").alias("least"))
        # beyond the replayed ones: none of those touches its sets, or it were not the least there
        both = rest.join(first.select("a", "b"), ["a", "b"], "left_anti").join(ends.withColumnRenamed("least", "la"), "a").join(ends.select(F.col("a").alias("b"), F.col("least").alias("lb")), "b").where((F.col("la") == rank) & (F.col("lb") == rank))
        moved = store(done.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("raiz"))))
        to = lambda c: moved.select(F.col("a").alias(c), F.col("raiz").alias(f"{c}_"))
        named = sets.join(to("raiz"), "raiz", "left").select("chave", F.coalesce("raiz_", "raiz").alias("raiz"), "fontes")
        # a set has a listing of each source at most, so its list is as short as the catalogue
        lists = named.select("raiz", F.explode("fontes").alias("f")).groupBy("raiz").agg(F.collect_set("f").alias("fontes"))
        grown = store(named.drop("fontes").join(lists, "raiz"))
        left = rest.select("comp", *_RANK, "first", "second", "a", "b").join(to("a"), "a", "left").join(to("b"), "b", "left")
        next_ = store(left.select("comp", *_RANK, "first", "second", F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b")))
        for old in (todo, sets, live, moved):
            drop(old)
        todo, sets = next_, grown


def replay_listings(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, raiz): what ``replay`` makes of the edges between these listings, which are not listed one by one.

    ``raiz`` is the set a listing is in before, ``fontes`` that set's sources (null: the listing's own). Listings are
    taken in rank order; each joins the next later one that agrees with it and whose set shares no source with its
    own, until there is none. Those that wait lie in heaps, one for each profile of attributes and sources of their
    sets, so a listing looks at the tops of heaps.
    """
    pdf = pdf.sort_values(["r1", "ord", "chave"])
    lead, order, key, start = (pdf[c].tolist() for c in ("r1", "ord", "chave", "raiz"))
    bits: dict[str, int] = {}
    parent: dict[str, str] = {}
    held: dict[str, int] = {}
    members: dict[str, list[int]] = {}
    for i, (root, own, all_) in enumerate(zip(start, pdf["fonte"], pdf["fontes"], strict=True)):
        if root not in parent:
            parent[root], members[root] = root, []
            held[root] = sum(bits.setdefault(f, 1 << len(bits)) for f in ([own] if all_ is None else all_))
        members[root].append(i)

    def find(k: str) -> str:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    numbers: dict[tuple, int] = {}
    kinds: list[tuple] = []
    cells: dict[tuple, list[tuple[float, int]]] = {}
    waiting: list[dict[int, list[tuple[int, str, int]]]] = []
    profile = []
    unknown = lambda v: None if v is None or v != v else v
    for i, row in enumerate(zip(*[pdf[c].tolist() for c in (*_SAME, "area", "banheiros", "vagas", "condominio")], strict=True)):
        kind = (*row[:5], *map(unknown, row[5:]))
        if kind not in numbers:
            numbers[kind] = len(kinds)
            cells.setdefault(kind[:4], []).append((kind[4], len(kinds)))
            kinds.append(kind)
            waiting.append({})
        profile.append(numbers[kind])
        waiting[profile[i]].setdefault(held[start[i]], []).append((order[i], key[i], i))  # in order, so a heap
    for areas in cells.values():
        areas.sort()
    known: dict[int, list[int]] = {}

    def agreeing(p: int) -> list[int]:
        if p not in known:
            *same, area, baths, cars, fee = kinds[p]
            areas = cells[tuple(same)]
            at = bisect_left(areas, (area, -1))
            out = []
            for places in (range(at, len(areas)), range(at - 1, -1, -1)):
                for k in places:
                    b, q = areas[k]
                    far, most = abs(area - b), max(2.0, 0.04 * max(area, b))
                    if far > most * 1.000001:
                        break
                    _, _, _, _, _, baths_, cars_, fee_ = kinds[q]
                    if far <= most and all(u is None or v is None or u == v for u, v in ((baths, baths_), (cars, cars_))) and (fee is None or fee_ is None or abs(fee - fee_) <= 5):
                        out.append(q)
            known[p] = out
        return known[p]

    def following(x: int) -> tuple | None:
        """The first edge of a listing that can be used."""
        mine, best = held[find(start[x])], None
        for q in agreeing(profile[x]):
            for other in list(waiting[q]):
                if other & mine:
                    continue
                heap = waiting[q][other]
                while heap and (heap[0][0] <= order[x] or held[find(start[heap[0][2]])] != other):  # passed, or its set has grown
                    heapq.heappop(heap)
                if not heap:
                    del waiting[q][other]
                elif best is None or (heap[0][0], key[x], heap[0][1]) < best[:3]:
                    best = (heap[0][0], key[x], heap[0][1], x, heap[0][2])
        return best

    i = 0
    while i < len(key):
        j = i + 1
        while j < len(key) and (lead[j], order[j]) == (lead[i], order[i]):
            j += 1
        while found := [e for x in range(i, j) if (e := following(x))]:
            *_, x, y = min(found)
            a, b = find(start[x]), find(start[y])
            parent[b] = a
            held[a] |= held.pop(b)
            members[a] += members.pop(b)
            for k in members[a]:
                if k >= j:  # the others have been taken
                    heapq.heappush(waiting[profile[k]].setdefault(held[a], []), (order[k], key[k], k))
        i = j
    return pd.DataFrame([(k, find(k)) for k in parent], columns=["a", "raiz"])


def attribute_sets(state: DataFrame, first: DataFrame, store: Callable[[DataFrame], DataFrame], batch: int = BATCH, drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """(chave, raiz) of every key with an edge: the sets that ``first`` (chave, raiz) become by attributes.

    Listings can meet within a run of areas each of which may agree with the next, and through a set that has
    listings in several runs; what hangs together so is replayed in one task. Where that is more than ``batch``
    listings its edges are listed and taken in rounds.
    """
    own = _comparable(state).where("ord IS NOT NULL AND fonte IS NOT NULL")
    sizes = own.groupBy(*_SAME, "area").agg(F.count(F.lit(1)).alias("n"), F.min("fonte").alias("f1"), F.max("fonte").alias("f2"))
    by = Window.partitionBy(*_SAME).orderBy("area")
    apart = F.col("area") - F.lag("area").over(by) > F.greatest(F.lit(2.0), 0.04 * F.col("area")) * 1.000001
    sizes = sizes.withColumn("_apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("run", F.sum("_apart").over(by))
    # a number for each run; runs that share one are only replayed together
    sizes = store(sizes.withColumn("cell", F.xxhash64(*_SAME, "run")).join(_leads(state), "aluguel"))
    cells = sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.min("f1").alias("f1"), F.max("f2").alias("f2")).where("f1 <> f2")
    inside = sizes.join(cells.select("cell"), "cell").select(*_SAME, "area", "cell", "r1")
    sets = first.join(state.select("chave", "fonte"), "chave").groupBy("raiz").agg(F.collect_set("fonte").alias("fontes")).where(F.size("fontes") > 1)
    bound = first.join(sets, "raiz")
    rows = own.join(inside, [*_SAME, "area"]).join(bound, "chave", "left").withColumn("raiz", F.coalesce("raiz", "chave"))
    rows = store(rows)
    ends = rows.where("fontes IS NOT NULL").groupBy("raiz").agg(F.collect_set("cell").alias("cells")).where(F.size("cells") > 1)
    links = ends.select(F.array_min("cells").alias("a"), F.explode("cells").alias("b")).where("a <> b")
    comp = label_components(links, store).withColumnRenamed("chave", "cell")
    whole = F.coalesce("comp", "cell")
    large = store(cells.join(comp, "cell", "left").groupBy(whole.alias("comp")).agg(F.sum("n").alias("n")).where(F.col("n") > batch).select("comp"))
    placed = rows.join(comp, "cell", "left").withColumn("comp", whole)
    tasks = max(1, -(-rows.count() // ROWS))
    few = placed.join(F.broadcast(large), "comp", "left_anti").withColumn("task", F.pmod(F.xxhash64("comp"), F.lit(tasks)))
    moved = few.select("task", "r1", "ord", "chave", "fonte", "fontes", "raiz", *_SAME, "area", "banheiros", "vagas", "condominio").groupBy("task").applyInPandas(replay_listings, "a string, raiz string")
    if not large.isEmpty():
        many = store(placed.join(large, "comp"))
        held = bound.join(many.select("raiz").distinct(), "raiz").where("chave <> raiz")
        zero = F.lit(0).cast("long")
        edges = store(held.select(F.lit(0).alias("stage"), zero.alias("r1"), zero.alias("r2"), zero.alias("r3"), F.col("raiz").alias("a"), F.col("chave").alias("b")).unionByName(_paired(many.drop("raiz", "fontes", "cell", "comp"))))
        late = constrained_sets(edges, state.select("chave", "fonte"), store, batch, drop)
        moved = moved.unionByName(many.select("chave", F.col("raiz").alias("a")).join(late, "chave").select("a", "raiz").distinct())
    moved = store(moved).withColumnRenamed("raiz", "raiz_")
    ends = first.select("chave", "raiz").unionByName(rows.select("chave", "raiz")).distinct()
    return ends.join(moved, ends["raiz"] == moved["a"], "left").select("chave", F.coalesce("raiz_", "raiz").alias("raiz"))


def priority() -> Column:
    """Order of principals: direct source, detailed, more photos, first seen, and the key as a reader orders words."""
    seen = F.coalesce(F.unix_millis(F.col("primeira_vez").try_cast("timestamp")), F.lit(0))
    return F.struct(F.col("plataforma").isin(*AGGREGATORS).cast("int").alias("p1"), (~F.col("detalhado")).cast("int").alias("p2"), (-F.size("fotos")).alias("p3"), seen.alias("p4"), F.collate("chave", "UNICODE").alias("p5"), F.col("chave").alias("p6"))


def principals(state: DataFrame, by: str = "grupo") -> DataFrame:
    """(by, chave): the principal of each set of rows."""
    return state.groupBy(by).agg(F.min_by("chave", priority()).alias("chave"))


def assign_groups(state: DataFrame, sources: DataFrame, store: Callable[[DataFrame], DataFrame], batch: int = BATCH, drop: Callable[[DataFrame], None] = lambda df: None) -> DataFrame:
    """The state with ``grupo`` set: g:{principal} for groups of two or more, else null."""
    edges = store(reference_edges(state, resolve_source(state.where("ativo"), sources)))
    named = constrained_sets(edges, state.select("chave", "fonte"), store, batch, drop)
    roots = attribute_sets(state, named, store, batch, drop)
    rows = state.drop("grupo").join(roots, "chave", "left")
    w = Window.partitionBy("raiz")
    lead = F.min_by("chave", priority()).over(w)
    grouped = rows.where("raiz IS NOT NULL").withColumn("grupo", F.when(F.count(F.lit(1)).over(w) > 1, F.concat(F.lit("g:"), lead)))
    alone = rows.where("raiz IS NULL").withColumn("grupo", F.lit(None).cast("string"))
    return grouped.unionByName(alone).drop("raiz").select(*state.columns)
