"""Micro-batches of captures merged into the state: the merge operator inside foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import apply_results
from ..sources.state import StateStore


def upsert_stream(listings: DataFrame, store: StateStore, checkpoint: str, clock: Callable[[int], str], complete: tuple[str, ...] = (), every: str | None = None) -> StreamingQuery:
    """Merge each micro-batch of listing rows (with ``ord``) into the store, once.

    ``clock`` gives a batch's time stamp by its number, so a replayed batch is merged alike. Only
    sources named ``complete`` may lose rows that a batch does not have. Without ``every`` what
    is there is processed and the query ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.createDataFrame([(f, True) for f in complete], "fonte string, completo boolean")
        store.update(lambda state: apply_results(state, batch, done, clock(number)).drop("acao"))

    w = listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def last_event_stream(events: DataFrame, key: str, kind: str, at: list[str]) -> DataFrame:
    """Streaming aggregation: the last event of each key so far."""
    return events.groupBy(key).agg(F.max_by(kind, F.struct(*at)).alias("status"), F.max(at[0]).alias("status_em"))
