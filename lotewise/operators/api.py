"""The commands and the payload behind a request's method and path, for a server to call: (status, JSON text).

Reads give the reader's payload; a PATCH sets a row's status and notes; a POST has a row's detail read again;
a search is started by a callback, one at a time.
"""

from __future__ import annotations

import json
import re
import threading
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame

from ..sources.state import StateStore
from . import commands, views

#: Rows and runs of one answer at most: a page shows the listings of one city.
MOST = 20_000


class Api:
    """Routes over a state store. ``reread(row)`` gives a row's detail as a DataFrame, ``regroup`` maps a state to one with groups, ``search(sources)`` runs a crawl."""

    def __init__(self, store: StateStore, runs: DataFrame, config, sources: DataFrame, now: Callable[[], str], reread: Callable | None = None, regroup: Callable[[DataFrame], DataFrame] = lambda s: s, search: Callable | None = None):
        self.store, self.runs, self.config, self.sources, self.now = store, runs, config, sources, now
        self.reread, self.regroup, self.search = reread, regroup, search
        self.job: dict = {"rodando": False, "erro": None}
        self.busy = threading.Lock()

    def answer(self, method: str, path: str, body: str = "") -> tuple[int, str]:
        """Status and JSON of a request."""
        try:
            return self._route(method, path, body)
        except commands.NotFound as e:
            return 404, json.dumps({"error": str(e)})
        except (ValueError, json.JSONDecodeError) as e:
            return 400, json.dumps({"error": str(e)})

    def _rows(self, df: DataFrame) -> list[dict]:
        got = [json.loads(r["json"]) for r in views.json_rows(df).limit(MOST + 1).collect()]
        if len(got) > MOST:
            raise ValueError(f"more than {MOST} rows; export them instead")
        return got

    def _route(self, method: str, path: str, body: str) -> tuple[int, str]:
        if (method, path) == ("GET", "/api/dados"):
            parts = views.payload(self.store.read(), self.runs, self.config, self.sources)
            return 200, json.dumps({"config": self._rows(parts["config"])[0], "imoveis": self._rows(parts["imoveis"]), "execucoes": self._rows(parts["execucoes"]), "busca": self.job}, ensure_ascii=False)
        if path == "/api/buscar" and method in ("GET", "POST"):
            if method == "GET":
                return 200, json.dumps(self.job)
            wanted = commands.parse_request(body).get("fontes")
            return (202, json.dumps(self.job)) if self._start([f for f in wanted if isinstance(f, str)] if isinstance(wanted, list) else None) else (409, json.dumps(self.job | {"error": "a search is running"}))
        m = re.fullmatch(r"/api/imoveis/([^/]+)(/detalhe)?", path)
        if m and method == ("POST" if m[2] else "PATCH"):
            key = unquote(m[1])
            return 200, json.dumps(self._again(key) if m[2] else self._change(key, commands.parse_request(body)), ensure_ascii=False)
        return 404, json.dumps({"error": "no such route"})

    def _change(self, key: str, fields: dict) -> dict:
        def change(state: DataFrame) -> DataFrame:
            commands.lookup(state, key)
            if isinstance(fields.get("status"), str):
                state = commands.set_status(state, key, fields["status"], self.now())
            return commands.replace_notes(state, key, fields["notas"]) if isinstance(fields.get("notas"), str) else state

        return self._rows(commands.lookup(self.store.update(change), key))[0]

    def _again(self, key: str) -> dict:
        if self.reread is None:
            raise ValueError("details cannot be read here")
        new = self.store.update(lambda s: commands.read_again(s, key, self.reread(commands.lookup(s, key)), self.regroup))
        return self._rows(commands.lookup(new, key))[0]

    def _start(self, wanted: list[str] | None) -> bool:
        if self.search is None or not self.busy.acquire(blocking=False):
            return False
        self.job = {"rodando": True, "erro": None}

        def work() -> None:
            try:
                self.search(wanted)
                self.job = {"rodando": False, "erro": None}
            except Exception as e:  # told to whoever asks next
                self.job = {"rodando": False, "erro": str(e)}
            finally:
                self.busy.release()

        threading.Thread(target=work, daemon=True).start()
        return True
