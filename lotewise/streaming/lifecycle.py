"""Lifecycle and price history as keyed streaming state: each listing's own, updated by its sightings, without a state table to rewrite.

A sighting has chave, ord, visto (the scan's time stamp), em (the same as event time), aluguel, condominio, iptu, total.
Of a scan the first row of a key counts, and a micro-batch that holds several scans applies them in their order, so
batches may be cut in any way. The rules are those of ``operators.merge``. A listing that is not seen for
``absent`` becomes inactive when the watermark passes that time; without ``absent`` none does.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merge import HISTORY

#: The state of a listing: condominium fee and tax stay when a later sighting lacks them.
_LIFE = "primeira_vez string, ultima_vez string, ativo boolean, inativo_desde string, condominio double, iptu double, datas array<string>, alugueis array<double>, totais array<double>"
#: What a change gives: the lifecycle, the history and what was done.
CHANGES = "chave string, primeira_vez string, ultima_vez string, ativo boolean, inativo_desde string, historico_precos array<struct<data:string,aluguel:double,total:double>>, acao string"


def _known(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) else float(x)


def _total(rent: float | None, condo: float | None, tax: float | None, said: float | None) -> float | None:
    """The larger of the stated total and the sum of the parts; none of either is null."""
    parts = math.floor((rent + (condo or 0.0) + (tax or 0.0)) * 100 + 0.5) / 100 if rent is not None else 0.0
    return max(said or 0.0, parts) or None


class Lifecycle(StatefulProcessor):
    def __init__(self, absent: dt.timedelta | None = None):
        self.absent = absent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("vida", _LIFE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["visto", "ord"]).drop_duplicates("visto")  # a row for each scan
        kept = self.life.get() if self.life.exists() else None
        first, last, condo, tax = (kept[0], kept[1], kept[4], kept[5]) if kept else (None, None, None, None)
        days, rents, totals = (list(kept[6] or []), *([_known(x) for x in k or []] for k in kept[7:9])) if kept else ([], [], [])
        new = kept is None
        for r in seen.itertuples():
            if last is not None and r.visto < last:  # a scan that came late changes nothing
                continue
            rent, said = _known(r.aluguel), _known(r.total)
            if first is None:  # an inserted row is taken as it is
                condo, tax, total = _known(r.condominio), _known(r.iptu), said
            else:
                condo, tax = (b if b is not None else a for a, b in ((condo, _known(r.condominio)), (tax, _known(r.iptu))))
                total = _total(rent, condo, tax, said) if rent is not None else None
            first, last = first or r.visto, r.visto
            if not rents or rents[-1] != rent:
                days, rents, totals = [*days, r.visto[:10]][-HISTORY:], [*rents, rent][-HISTORY:], [*totals, total][-HISTORY:]
        self.life.update((first, last, True, None, condo, tax, days, rents, totals))
        if self.absent is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((pd.Timestamp(last).tz_localize(None) + self.absent - pd.Timestamp(0)).total_seconds() * 1000))
        yield self._change(key[0], "inserir" if new else "atualizar")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The time in which the listing had to be seen again is over."""
        life = list(self.life.get())
        when = dt.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, dt.UTC)
        life[2:4] = [False, when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z"]
        self.life.update(tuple(life))
        yield self._change(key[0], "desativar")

    def _change(self, key: str, action: str) -> pd.DataFrame:
        first, last, active, gone, _, _, days, rents, totals = self.life.get()
        history = [{"data": d, "aluguel": r, "total": t} for d, r, t in zip(days, rents, totals, strict=True)]
        return pd.DataFrame({"chave": [key], "primeira_vez": [first], "ultima_vez": [last], "ativo": [active], "inativo_desde": [gone], "historico_precos": [history], "acao": [action]})

    def close(self) -> None:
        pass


def lifecycle_stream(sightings: DataFrame, absent: dt.timedelta | None = None, late: str = "0 seconds") -> DataFrame:
    """Each key's lifecycle after every micro-batch that has it (update mode); the state store must be RocksDB."""
    rows = sightings.where("chave IS NOT NULL AND visto IS NOT NULL")
    if absent is not None:
        rows = rows.withWatermark("em", late)
    return rows.groupBy("chave").transformWithStateInPandas(Lifecycle(absent), CHANGES, "Update", "EventTime" if absent is not None else "None")


def prepare(spark) -> None:
    """Keyed state of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
