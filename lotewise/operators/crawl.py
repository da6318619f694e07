"""A whole run from captures: scan, criteria, details, overlay, criteria again, merge, groups, run log.

Each source is read in a thread of its own, at most ``concorrencia`` at a time, and its rows are stored: that write
is the only evaluation of its scan, and its counters are observed on it. Whatever fails while a source is read,
parsing included, is that source's error in the run log; the others are merged, once, and the merge's counters are
observed on its write. All jobs of a source carry its tag, so a stop ends those that run. A callback hears of each
change of phase, of counters as they are known, and of finished tasks while jobs run.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..schema import DETAIL_FIELDS, RUN
from ..sources.shared import stored
from . import criteria, merge

PHASES = ("aguardando", "buscando", "detalhando", "ok", "erro")
#: Failures of detail pages that are told one by one.
TOLD = 3
#: Seconds between two looks at running jobs.
LOOK = 0.2
Progress = Callable[[dict[str, dict]], None]
Scan = tuple[DataFrame, dict]


class Cancelled(RuntimeError):
    """The caller stopped the run."""


def detail_pages(rows: DataFrame, state: DataFrame, details: DataFrame, again: bool = False) -> DataFrame:
    """The detail pages (fonte, id, detail fields, erro) of rows not yet detailed, or of all, with the rows' ``ord``."""
    due = merge.to_detail(rows, state, again).select("fonte", "id", F.col("ord").alias("ord"))
    return details.drop("ord").join(due, ["fonte", "id"])


def with_details(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with the fields of their readable detail pages laid over them."""
    fields = [c for c in pages.columns if (c in DETAIL_FIELDS or c in rows.columns) and c not in ("fonte", "id", "ord")]
    return merge.overlay(rows, pages.where("erro IS NULL").select("fonte", "id", *fields), ["fonte", "id"])


class _Run:
    def __init__(self, spark, names: list[str], on_progress: Progress | None, stop: Callable[[], bool] | None):
        self.context, self.id = spark.sparkContext, uuid.uuid4().hex
        self.told = {f: {"fase": PHASES[0], "msg": None} for f in names}
        self.on_progress, self.stop = on_progress, stop
        self.over, self.mutex = threading.Event(), threading.Lock()

    def say(self, f: str, **what) -> None:
        with self.mutex:
            self.told[f] = self.told[f] | what
            if self.on_progress:
                self.on_progress({k: dict(v) for k, v in self.told.items()})

    def check(self) -> None:
        if self.over.is_set():
            raise Cancelled("stopped")

    def tagged(self, tag: str, work: Callable):
        """Work whose jobs carry a tag and a group of their own."""

        def run(*args):
            self.check()
            self.context.addJobTag(f"{self.id}-{tag}")
            self.context.setJobGroup(f"{self.id}-{tag}", tag)
            try:
                return work(*args)
            finally:
                self.context.clearJobTags()
                self.context.setLocalProperty("spark.jobGroup.id", None)

        return run

    def tasks(self, tag: str) -> tuple[int, int]:
        """Finished tasks and all tasks of a tag's running jobs."""
        tracker = self.context.statusTracker()
        infos = [s for j in tracker.getJobIdsForGroup(f"{self.id}-{tag}") if (i := tracker.getJobInfo(j)) for k in i.stageIds if (s := tracker.getStageInfo(k))]
        return sum(s.numCompletedTasks for s in infos), sum(s.numTasks for s in infos)

    def finish(self, futures: dict[Future, str], tell: bool) -> None:
        """Wait for all; tell of their tasks meanwhile, and end them if the caller wants it."""
        left = set(futures)
        while left:
            done, left = wait(left, timeout=LOOK, return_when=FIRST_COMPLETED)
            if not self.over.is_set() and self.stop and self.stop():
                self.over.set()
            for f in left:
                tag = futures[f]
                if self.over.is_set():
                    f.cancel()
                    self.context.cancelJobsWithTag(f"{self.id}-{tag}")
                elif tell and self.on_progress and self.told[tag]["fase"] in PHASES[1:3]:
                    ready, of = self.tasks(tag)
                    if of and self.told[tag].get("tarefas") != [ready, of]:
                        self.say(tag, tarefas=[ready, of])
        self.check()


def observed(df: DataFrame, store: Callable[[DataFrame, str], DataFrame], name: str, **counters) -> tuple[DataFrame, dict[str, int]]:
    """``df`` stored, and the counters that were observed on that write."""
    seen = Observation()
    out = store(df.observe(seen, *[c.alias(k) for k, c in counters.items()]), name)
    return out, {k: int(v or 0) for k, v in seen.get.items()}


def _reason(e: Exception) -> str:
    """What an error says, without Spark's traces."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    python = [x for x in lines if ": " in x and x.split(":")[0].replace(".", "").isidentifier() and not x.startswith("File")]
    return (python[-1] if "Traceback (most recent call last):" in lines and python else lines[0] if lines else type(e).__name__)[:500]


def run(state: DataFrame, scans: dict[str, Scan | Callable[[], Scan]], config, now: str, end: str, *, details: DataFrame | None = None, again: bool = False, regroup: Callable[[DataFrame], DataFrame] | None = None, on_progress: Progress | None = None, stop: Callable[[], bool] | None = None, store: Callable[[DataFrame, str], DataFrame] = stored) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, run log row, new keys: inicio, pos, chave).

    ``scans`` has for each source id its rows (one an id) with ``ord`` and what is known of the scan (completo, erro, avisos),
    or a function that gives both. ``details`` as in ``detail_pages``. ``stop`` is asked all the time.
    """
    spark = state.sparkSession
    control = _Run(spark, list(scans), on_progress, stop)
    meets = lambda df: criteria.meets_criteria(df, config.aluguel_max, config.tipos, config.quartos_min, config.cidade)
    one = F.count(F.lit(1))

    def read(f: str, given) -> tuple[DataFrame | None, dict]:
        began = time.monotonic()
        fact = {"ok": False, "encontrados": 0, "novos": 0, "atualizados": 0, "removidos": 0, "detalhados": 0, "erro": None, "avisos": [], "ms": 0, "completo": False}
        kept = None
        try:
            control.say(f, fase="buscando")
            rows, meta = given() if callable(given) else given
            fact |= {"erro": meta.get("erro"), "avisos": list(meta.get("avisos", [])), "completo": bool(meta.get("completo"))}
            if not fact["erro"]:
                rows, n = observed(meets(rows), store, f"rows-{f}", encontrados=one)
                control.say(f, **n)
                if config.buscar_detalhes and details is not None:
                    control.check()
                    control.say(f, fase="detalhando")
                    bad = F.col("erro").isNotNull()
                    pages, seen = observed(detail_pages(rows, state, details, again), store, f"details-{f}", detalhados=F.count_if(~bad), falhas=F.count_if(bad))
                    first = [f"detalhe {r['id']}: {r['erro']}" for r in pages.where(bad).orderBy("ord").limit(TOLD).select("id", "erro").collect()]
                    fact["avisos"] += first + ([f"... e mais {seen['falhas'] - TOLD} falhas de detalhe"] if seen["falhas"] > TOLD else [])
                    fact["detalhados"] = seen["detalhados"]
                    control.say(f, **seen)
                    control.check()
                    rows, n = observed(meets(with_details(rows, pages)), store, f"detailed-{f}", encontrados=one)  # details may end a row's right to be here
                kept, fact = rows, fact | n | {"ok": True}
        except Cancelled:
            raise
        except Exception as e:  # the source's, whatever it is; a stop is told apart by the caller
            control.check()
            fact |= {"erro": _reason(e), "detalhados": 0, "encontrados": 0}
        fact["ms"] = int(1000 * (time.monotonic() - began))
        control.say(f, **({"fase": "ok", "encontrados": fact["encontrados"]} if fact["ok"] else {"fase": "erro", "msg": fact["erro"]}))
        return kept, fact

    if stop and stop():
        raise Cancelled("stopped before the first source")
    with ThreadPoolExecutor(max_workers=max(1, config.concorrencia)) as pool:
        futures = {pool.submit(control.tagged(f, read), f, given): f for f, given in scans.items()}
        control.finish(futures, True)
        got = {futures[x]: x.result() for x in futures}
        facts = {f: got[f][1] for f in scans}
        parts = [got[f][0] for f in scans if got[f][0] is not None]
        changes = state.withColumn("acao", F.lit("manter"))
        if parts:
            complete = spark.createDataFrame([(f, x["completo"]) for f, x in facts.items() if x["ok"]], "fonte string, completo boolean")
            changes = merge.apply_results(state, merge.union_scans(parts), complete, now)
        kinds = {"inserir": "novos", "atualizar": "atualizados", "desativar": "removidos"}
        counters = {f"{k} {i}": F.count_if((F.col("fonte") == f) & (F.col("acao") == a)) for i, f in enumerate(facts) for a, k in kinds.items()}
        work = control.tagged("estado", lambda: observed(changes, store, "state", _n=one, **counters))
        merging = pool.submit(work)
        control.finish({merging: "estado"}, False)
        changes, n = merging.result()
    for i, f in enumerate(facts):
        if facts[f]["ok"]:
            facts[f] |= {k: n[f"{k} {i}"] for k in kinds.values()}
    fields = ("ok", "encontrados", "novos", "atualizados", "removidos", "detalhados", "erro", "avisos", "ms")
    log = spark.createDataFrame([(now, now, end, {f: tuple(x[k] for k in fields) for f, x in facts.items()}, sum(x["novos"] for x in facts.values()))], RUN)
    new = changes.drop("acao")
    return (regroup(new) if regroup else new), log, merge.run_news(changes, now)


def listen(on_progress: Callable[[dict], None]):
    """A streaming listener that tells of each micro-batch: rows in, rows a second, state rows."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            on_progress({"fase": "buscando", "id": str(event.id)})

        def onQueryProgress(self, event) -> None:
            p = event.progress
            on_progress({"fase": "ok", "id": str(p.id), "lote": p.batchId, "linhas": p.numInputRows})

        def onQueryIdle(self, event) -> None:
            on_progress({"fase": "aguardando", "id": str(event.id)})

        def onQueryTerminated(self, event) -> None:
            on_progress({"fase": "erro" if event.exception else "ok", "id": str(event.id), "msg": event.exception})

    return Listener()
