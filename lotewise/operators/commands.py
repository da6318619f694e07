"""Commands on the state: status, notes, annotations, run log. Each maps a state to a new state."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LISTING, STATUSES, columns
from .merge import merged, merged_total

NOTES, SUMMARY, ALERTS, RUNS = 5000, 600, 6, 50


#: Form of a key (fixed value), and characters of the largest request.
KEY, BODY = r"(?i)[a-z0-9_-]+:[\w.-]+", 100_000


class NotFound(ValueError):
    """A command names a row that the state does not have."""


def _of(chave: str):
    return F.col("chave") == chave


def lookup(state: DataFrame, chave: str) -> DataFrame:
    """The row of a key; a key that is malformed or not there is an error."""
    if not re.fullmatch(KEY, chave):
        raise ValueError(f"malformed key {chave!r}")
    row = state.where(_of(chave))
    if row.isEmpty():
        raise NotFound(f"no listing {chave!r}")
    return row


def parse_request(body: str) -> dict:
    """The fields of a change request; too long or not a JSON object is an error."""
    if len(body) > BODY:
        raise ValueError("the request is too long")
    got = json.loads(body) if body else {}
    if not isinstance(got, dict):
        raise ValueError("the request is no JSON object")
    return got


def parse_flags(args: list[str], known: set[str], whole: set[str] = frozenset()) -> tuple[list[str], dict[str, str | bool]]:
    """(positional arguments, flags) of a command line; unknown flags, and flags in ``whole`` that are no integer of 1 or more, are errors."""
    rest, flags, at = [], {}, 0
    while at < len(args):
        a = args[at]
        at += 1
        if not a.startswith("--"):
            rest.append(a)
            continue
        if a[2:] not in known:
            raise ValueError(f"unknown flag {a}")
        flags[a[2:]] = True
        if at < len(args) and not args[at].startswith("--"):
            flags[a[2:]] = args[at]
            at += 1
    for name in whole & set(flags):
        if not str(flags[name]).isdigit() or int(flags[name]) < 1:
            raise ValueError(f"--{name} takes an integer of 1 or more")
    return rest, flags


def set_status(state: DataFrame, chave: str, status: str, now: str) -> DataFrame:
    """Any transition between known statuses is allowed."""
    if status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    lookup(state, chave)
    return state.withColumns({"status": F.when(_of(chave), status).otherwise(F.col("status")), "status_em": F.when(_of(chave), now).otherwise(F.col("status_em"))})


def annotate(state: DataFrame, chave: str, summary: str, score: float | None, alerts: list[str], now: str) -> DataFrame:
    """Score 0 to 100 or none, a summary, alerts."""
    summary, alerts = summary.strip(), [x for x in map(str.strip, alerts) if x]
    if not summary:
        raise ValueError("a summary is required")
    if score is not None and not 0 <= score <= 100:
        raise ValueError("the score is 0 to 100")
    lookup(state, chave)
    note = F.struct(F.lit(None if score is None else int(score + 0.5)).cast("int").alias("nota"), F.lit(summary[:SUMMARY]).alias("resumo"), F.array(*map(F.lit, alerts[:ALERTS])).cast("array<string>").alias("alertas"), F.lit(now).alias("data"))
    return state.withColumn("ia", F.when(_of(chave), note).otherwise(F.col("ia")))


def append_note(state: DataFrame, chave: str, text: str, now: str) -> DataFrame:
    """A dated line at the end of the notes; the last 5000 characters stay."""
    lookup(state, chave)
    line = f"[{now[8:10]}/{now[5:7]}/{now[:4]}] {text.strip()}"
    grown = F.concat_ws("\n", F.when(F.col("notas") != "", F.col("notas")), F.lit(line))
    return state.withColumn("notas", F.when(_of(chave), F.right(grown, F.lit(NOTES))).otherwise(F.col("notas")))


def replace_notes(state: DataFrame, chave: str, text: str) -> DataFrame:
    """Notes replaced; the first 5000 characters count."""
    lookup(state, chave)
    return state.withColumn("notas", F.when(_of(chave), text[:NOTES]).otherwise(F.col("notas")))


def read_again(state: DataFrame, chave: str, detail: DataFrame, regroup) -> DataFrame:
    """The state after a row's detail page was read again: its fields that are not null laid over the row, merged, and groups made anew.

    ``detail`` has the row's ``fonte`` and ``id``; ``regroup`` maps a state to one with groups.
    """
    prev = lookup(state, chave)
    fields = [n for n, _ in columns(LISTING)]
    given = [c for c in detail.columns if c in fields and c not in ("fonte", "id")]
    d = detail.select("fonte", "id", *[F.col(c).alias(f"_{c}") for c in given]).limit(1)
    both = prev.join(d, ["fonte", "id"], "left")
    incoming = F.struct(*[(F.lit(True) if c == "detalhado" else F.coalesce(f"_{c}", c) if c in given else F.col(c)).alias(c) for c in fields]).alias("n")
    j = both.select(F.struct(*state.columns).alias("p"), incoming)
    total = F.when(merged("aluguel", "double").isNotNull(), merged_total())
    new = j.select(*[(total if c == "total" else merged(c, k)).cast(k).alias(c) for c, k in columns(LISTING)], *[F.col(f"p.{c}").alias(c) for c in state.columns if c not in fields])
    return regroup(state.where(~_of(chave)).unionByName(new.select(*state.columns)))


def append_run(runs: DataFrame, run: DataFrame) -> DataFrame:
    """The run log with one more run; the last 50 stay."""
    return runs.unionByName(run).orderBy(F.desc("inicio")).limit(RUNS)


def status_from_events(events: DataFrame, key: str, kind: str, at: list[str]) -> DataFrame:
    """Each key's last event, as it is; ``transitions`` has what events do to a status."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(*at)).alias("status"), F.max(at[0]).alias("status_em"))


def remember(local: DataFrame, changes: DataFrame, key: str = "chave") -> DataFrame:
    """A reader's own fields with changes laid over them: a field that a change leaves null stays."""
    names = [c for c in local.columns if c != key]
    j = local.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "full_outer")
    return j.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def overlay_local(base: DataFrame, local: DataFrame, key: str = "chave") -> DataFrame:
    """Locally stored fields win over the base's by key."""
    names = [c for c in local.columns if c != key]
    j = base.join(local.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return j.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in base.columns])
