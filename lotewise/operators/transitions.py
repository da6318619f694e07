"""Status transitions as maps that compose: a key's history is a fold, taken in parts of bounded size.

What can be undone is part of a position: the status, and the one before the last change while that can be
undone. An event is a map over all positions (six statuses, each with seven memories), and maps compose
associatively, so runs of a key's events become one map each, wherever they lie, and the runs' maps compose in
order. Events are dealt by ranges of key and time, so a key with a third of all events lies in many partitions;
a run is at most ``RUN`` consecutive events of one, and no list is longer than that or than the partitions of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATUSES

#: Kinds of event: a status is set; a reader writes to the advertiser; the star and the discard button are pressed; the last change is taken back.
SET, CONTACT, STAR, DISCARD, UNDO = "marcar", "contatar", "favoritar", "descartar", "desfazer"
#: Events folded in one row.
RUN = 4096
_RUN_BITS, _BLOCK_BITS = 12, 24
_FIRST = STATUSES[0]
Position = tuple[str, str | None]
POSITIONS: list[Position] = [(s, before) for s in STATUSES for before in (None, *STATUSES)]


def moved(kind: str, to: str | None, at: Position) -> Position:
    """The position after an event; undoing is possible once after a change."""
    status, before = at
    if kind == UNDO:
        return at if before is None else (before, None)
    if kind == CONTACT:
        return ("contatado", status) if status in ("novo", "interesse") else at
    if kind == STAR:
        return ("novo" if status == "interesse" else "interesse", status)
    if kind == DISCARD:
        return ("novo" if status == "descartado" else "descartado", status)
    if kind == SET and to in STATUSES:
        return (to, status)
    return at


def _map(step: Callable[[Position], Position]) -> Column:
    return F.array(*[F.lit(POSITIONS.index(step(p))).cast("tinyint") for p in POSITIONS])


def event_map(kind: str, to: str) -> Column:
    """An event's map: for each position the number of the one after it. Unknown kinds and statuses move nothing."""
    kinds = {(k, ""): (lambda p, k=k: moved(k, None, p)) for k in (CONTACT, STAR, DISCARD, UNDO)} | {(SET, s): (lambda p, s=s: moved(SET, s, p)) for s in STATUSES}
    table = F.create_map(*[x for (k, s), f in kinds.items() for x in (F.lit(f"{k} {s}"), _map(f))])
    name = F.concat(F.coalesce(F.col(kind), F.lit("")), F.lit(" "), F.when(F.col(kind) == SET, F.coalesce(F.col(to), F.lit(""))).otherwise(""))
    return F.coalesce(F.try_element_at(table, name), _map(lambda p: p))


def _composed(maps: Column) -> Column:
    """The maps of a list one after another."""
    return F.aggregate(maps, _map(lambda p: p), lambda done, m: F.transform(done, lambda i: F.get(m, i.cast("int"))))


def _folded(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    runs = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, "map"))).alias("maps"), F.sum("n").alias("n"), F.max("em").alias("em"))
    return runs.select(*by, _composed(F.transform("maps", lambda x: x["map"])).alias("map"), "n", "em")


def histories(events: DataFrame, key: str, kind: str, to: str, at: list[str]) -> DataFrame:
    """(key, map, n, em): each key's whole history as one map, its number of events and the time of the last.

    ``at`` orders events, the time first; events that are equal in all of it are taken by kind and status.
    """
    known = events.where(F.col(key).isNotNull()).select(key, *at, F.coalesce(kind, F.lit("")).alias("_k"), F.coalesce(to, F.lit("")).alias("_s"))
    placed = known.repartitionByRange(key, *at, "_k", "_s").sortWithinPartitions(key, *at, "_k", "_s")
    place = placed.withColumn("_id", F.monotonically_increasing_id())  # partition, and place in it
    rows = place.select(key, "_id", event_map("_k", "_s").alias("map"), F.lit(1).cast("long").alias("n"), F.col(at[0]).alias("em"), F.shiftrightunsigned("_id", _RUN_BITS).alias("_run"))
    runs = _folded(rows, [key, "_run"], ["_id"])
    blocks = _folded(runs.withColumn("_block", F.shiftrightunsigned("_run", _BLOCK_BITS - _RUN_BITS)), [key, "_block"], ["_run"])
    return _folded(blocks, [key], ["_block"])


def status_after(start: Column, history: Column) -> Column:
    """The status that a history leads to from a status (null: a new listing's), nothing being left to undo before it."""
    begin = F.create_map(*[x for s in STATUSES for x in (F.lit(s), F.lit(POSITIONS.index((s, None))))])
    end = F.get(history, F.coalesce(F.try_element_at(begin, F.coalesce(start, F.lit(_FIRST))), F.lit(POSITIONS.index((_FIRST, None)))).cast("int"))
    return F.get(F.array(*[F.lit(s) for s, _ in POSITIONS]), end.cast("int"))


def apply_events(state: DataFrame, events: DataFrame, at: list[str], key: str = "chave", kind: str = "evento", to: str = "para") -> DataFrame:
    """The state with the statuses that its readers' events lead to, and when the last one was; events of unknown keys are ignored."""
    h = histories(events, key, kind, to, at).select(key, F.col("map").alias("_map"), F.col("em").cast("string").alias("_em"))
    j = state.join(h, key, "left")
    new = {"status": F.when(F.col("_map").isNull(), F.col("status")).otherwise(status_after(F.col("status"), F.col("_map"))), "status_em": F.coalesce("_em", "status_em")}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in state.columns])
