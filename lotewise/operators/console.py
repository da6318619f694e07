"""Commands of the console, one call each: flags are checked, the state is read or changed, and an answer says what to print and the exit code.

An answer's rows are a DataFrame, in order where there is one, so nothing is gathered to be printed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STATUSES
from ..sources.state import StateStore
from . import commands, criteria, merge, views

#: Error codes (fixed values).
BAD_ARG, NOT_FOUND, BAD_COMMAND = "BAD_ARG", "NOT_FOUND", "BAD_CMD"
Search = Callable[[list[str] | None, bool | None, bool], tuple[DataFrame, DataFrame, DataFrame]]


@dataclass
class Answer:
    """An exit code, rows to print (one, or many in order), and for a failure its message and code."""

    code: int = 0
    rows: DataFrame | None = None
    error: str | None = None
    kind: str | None = None


class Console:
    """Commands over a state store, its run log (RUN) and the runs' new keys (NEWS). ``search(sources, details, again)`` runs a crawl."""

    def __init__(self, store: StateStore, runs: DataFrame, news: DataFrame, now: Callable[[], str], sources: tuple[str, ...] = (), search: Search | None = None):
        self.store, self.runs, self.news, self.now, self.sources, self.search = store, runs, news, now, sources, search
        self.known = {"resumo": self.summary, "listar": self.list, "estatisticas": self.statistics, "ver": self.show, "status": self.status, "nota": self.note, "anotar": self.annotate, "buscar": self.crawl}

    def call(self, args: list[str]) -> Answer:
        """What a command line does."""
        if not args or args[0] not in self.known:
            return Answer(1, None, f"unknown command {args[0]!r}" if args else "a command is missing", BAD_COMMAND)
        try:
            return self.known[args[0]](args[1:])
        except commands.NotFound as e:
            return Answer(1, None, str(e), NOT_FOUND)
        except ValueError as e:
            return Answer(1, None, str(e), BAD_ARG)

    def summary(self, args: list[str]) -> Answer:
        commands.parse_flags(args, {"format"})
        return Answer(rows=views.summary(self.store.read(), self.runs))

    def statistics(self, args: list[str]) -> Answer:
        commands.parse_flags(args, {"format"})
        return Answer(rows=views.sorted_stats(views.market_stats(self.store.read())))

    def list(self, args: list[str]) -> Answer:
        """The filtered list, one of each group, new ones first: compact rows with ``de``, or lines of a table."""
        _, flags = commands.parse_flags(args, {"todos", "status", "novos", "sem-ia", "limite", "format"}, {"limite"})
        state = self.store.read()
        status = flags.get("status")
        if status is not None and status not in STATUSES:
            raise ValueError(f"unknown status {status!r}")
        last = merge.news_of(merge.last_run(self.runs), self.news) if flags.get("novos") else None
        rows = criteria.console_filter(state, every=bool(flags.get("todos")), status=status, last_run=last, unread=bool(flags.get("sem-ia")))
        page = criteria.page_of(rows, None, "lista", int(flags["limite"]) if "limite" in flags else None)
        if flags.get("format") == "table":
            return Answer(rows=views.listing_table(page))
        place = page.select("chave", "de", criteria.position("lista").alias("_at"))
        whole = views.compact(state).join(place, "chave")
        return Answer(rows=whole.orderBy(F.desc("_at.k0"), "_at.k1", "_at.k2").drop("_at"))

    def show(self, args: list[str]) -> Answer:
        """A row whole, with the others of its group."""
        (key, *_), _ = self._words(args, 1)
        state = self.store.read()
        row = commands.lookup(state, key)
        others = state.alias("x").join(F.broadcast(row.select("grupo", F.col("chave").alias("_own"))).alias("r"), (F.col("x.grupo") == F.col("r.grupo")) & (F.col("x.chave") != F.col("_own")))  # one row
        also = others.agg(F.array_sort(F.collect_list(F.struct("x.ord", "x.chave", "x.url", "x.aluguel", "x.anunciante"))).alias("_o"))  # a group has a row for each source at most
        return Answer(rows=row.crossJoin(also).select(*state.columns, F.transform("_o", lambda o: o.dropFields("ord")).alias("tambem_em")))

    def status(self, args: list[str]) -> Answer:
        (key, status, *_), _ = self._words(args, 2)
        return self._changed(key, lambda s: commands.set_status(s, key, status, self.now()))

    def note(self, args: list[str]) -> Answer:
        (key, *text), _ = self._words(args, 2)
        return self._changed(key, lambda s: commands.append_note(s, key, " ".join(text), self.now()))

    def annotate(self, args: list[str]) -> Answer:
        alerts = [b for a, b in zip(args, args[1:], strict=False) if a == "--alerta"]
        (key, *_), flags = self._words(args, 1, {"nota", "resumo", "alerta"})
        score = flags.get("nota")
        try:
            score = None if score is None else float(score)
        except (TypeError, ValueError):
            raise ValueError("--nota takes a number from 0 to 100") from None
        summary = flags.get("resumo") if isinstance(flags.get("resumo"), str) else ""
        return self._changed(key, lambda s: commands.annotate(s, key, summary, score, alerts, self.now()))

    def crawl(self, args: list[str]) -> Answer:
        """A search of all sources, or of those named; the code is 0 if one of them could be read."""
        _, flags = commands.parse_flags(args, {"fonte", "sem-detalhes", "redetalhar", "format"})
        wanted = [f for f in map(str.strip, flags["fonte"].split(",")) if f] if isinstance(flags.get("fonte"), str) else None
        if unknown := [f for f in wanted or [] if f not in self.sources]:
            raise ValueError(f"unknown sources: {', '.join(unknown)}")
        if self.search is None:
            raise ValueError("no search here")
        state, log, news = self.search(wanted, False if flags.get("sem-detalhes") else None, bool(flags.get("redetalhar")))
        self.store.update(lambda _: state)
        self.runs, self.news = commands.append_run(self.runs, log), self.news.unionByName(news)
        told = log.select("inicio", "fim", F.explode("fontes").alias("fonte", "r")).select("inicio", "fim", "fonte", "r.*")
        good = told.where("ok").limit(1).count()
        return Answer(0 if good else 1, told)

    def _words(self, args: list[str], least: int, flags: frozenset | set = frozenset()) -> tuple[list[str], dict]:
        rest, given = commands.parse_flags(args, set(flags) | {"format"})
        if len(rest) < least:
            raise ValueError("the command needs a key" + (" and a value" if least > 1 else ""))
        return rest, given

    def _changed(self, key: str, change: Callable[[DataFrame], DataFrame]) -> Answer:
        def checked(state: DataFrame) -> DataFrame:
            commands.lookup(state, key)
            return change(state)

        return Answer(rows=commands.lookup(self.store.update(checked), key).select("chave", "status", "notas", "ia"))
