"""The state as versions: data is written to a folder of its own, then one exclusive commit makes it the next version.

``commits/N`` is a small file that names version N's folder under ``data``; it is created only if it does not
exist, so of two writers that read version N-1 one commits and the other gets a ``Conflict``. Nothing
that is being read is overwritten. A lock keeps writers from working in vain: it holds its owner's
token, is renewed while the owner works, and is taken over only when it has not been renewed for
two minutes. Both use the file system's atomic create through Hadoop, so they hold for any shared store.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NEWS, RUN, STATE, columns

KEEP = 3
LOCK_TIMEOUT, LOCK_STALE, LOCK_POLL, LOCK_RENEW = 30.0, 120.0, 0.075, 20.0


class Conflict(RuntimeError):
    """Another writer committed the version."""


class StateStore:
    """Versions of a state table under one path."""

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        at = self._fs.open(self._path(path))
        try:
            return bytes(at.readAllBytes()).decode()
        finally:
            at.close()

    def _create(self, path: str, text: str) -> None:
        """Write a small file that must not exist."""
        out = self._fs.create(self._path(path), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        at = self._path(f"{self.path}/commits")
        if not self._fs.exists(at):
            return []
        return sorted(int(n) for s in self._fs.listStatus(at) if (n := s.getPath().getName()).isdigit())

    def read(self, version: int | None = None) -> DataFrame:
        """The current state, or an empty one where nothing has been written."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.parquet(f"{self.path}/data/{self._text(f'{self.path}/commits/{version or have[-1]}')}")

    def write(self, state: DataFrame, after: int | None = None) -> int:
        """Commit the version after ``after`` (the latest, if not named); a ``Conflict`` if there is one already."""
        have = self.versions()
        base = after if after is not None else (have[-1] if have else 0)
        names = [n for n, _ in columns(self.schema)]
        folder = uuid.uuid4().hex
        state.select(*[c for c in names if c in state.columns]).write.parquet(f"{self.path}/data/{folder}")
        try:
            self._create(f"{self.path}/commits/{base + 1}", folder)
        except Exception as e:  # the store's own exception for "exists"
            self._fs.delete(self._path(f"{self.path}/data/{folder}"), True)
            if self._fs.exists(self._path(f"{self.path}/commits/{base + 1}")):
                raise Conflict(f"version {base + 1} of {self.path} was committed by another writer") from e
            raise
        for old in [v for v in self.versions() if v <= base + 1 - KEEP]:
            self._fs.delete(self._path(f"{self.path}/data/{self._text(f'{self.path}/commits/{old}')}"), True)
            self._fs.delete(self._path(f"{self.path}/commits/{old}"), False)
        return base + 1

    @contextmanager
    def lock(self):
        """Exclusive among writers; renewed while held, released only by its owner."""
        name, token, began = f"{self.path}/.lock", uuid.uuid4().hex, time.time()
        at, done = self._path(name), threading.Event()
        while True:
            try:
                self._create(name, token)
                break
            except Exception as e:  # the store's own exception for "exists"
                if self._fs.exists(at) and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > LOCK_STALE:
                    self._fs.delete(at, False)
                elif time.time() - began > LOCK_TIMEOUT:
                    raise TimeoutError(f"{self.path} is locked") from e
                time.sleep(LOCK_POLL)

        def renew() -> None:
            while not done.wait(LOCK_RENEW):
                self._fs.setTimes(at, int(time.time() * 1000), -1)

        threading.Thread(target=renew, daemon=True).start()
        try:
            yield token
        finally:
            done.set()
            if self._fs.exists(at) and self._text(name) == token:
                self._fs.delete(at, False)

    def update(self, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Read, change, write, under the lock."""
        with self.lock():
            have = self.versions()
            self.write(change(self.read()), have[-1] if have else 0)
            return self.read()


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, runs, new keys of runs) of a state document: one JSON object with ``imoveis`` by key and ``execucoes``.

    No file, or an object without ``imoveis``, is an empty state; text that is not JSON is an error. Rows
    keep the document's order in ``ord``.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    empty = tuple(spark.createDataFrame([], x) for x in (STATE, RUN, NEWS))
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return empty
    row = ",".join(f"{n}:{k}" for n, k in columns(STATE))
    runs = ",".join(f"{n}:{'array<string>' if n == 'novos' else k}" for n, k in columns(RUN))  # a document lists a run's new keys in it
    doc = spark.read.schema(f"imoveis map<string,struct<{row}>>, execucoes array<struct<{runs}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    names = [n for n, _ in columns(STATE)]
    flat = doc.select(F.posexplode("imoveis").alias("pos", "k", "r")).select(*[(F.col("pos").cast("long") if n == "ord" else F.coalesce("r.chave", "k") if n == "chave" else F.col(f"r.{n}")).alias(n) for n in names])
    told = doc.select(F.inline("execucoes"))
    return flat, told.withColumn("novos", F.coalesce(F.size("novos"), F.lit(0)).cast("long")), told.select("inicio", F.posexplode("novos").alias("pos", "chave")).withColumn("pos", F.col("pos").cast("long"))


def export_json(state: DataFrame, path: str) -> None:
    """Static export, nulls kept, private notes blanked; a folder that exists is refused."""
    state.withColumn("notas", F.lit("")).write.option("ignoreNullFields", "false").json(path)


def export_payload(parts: dict[str, DataFrame], path: str) -> None:
    """The parts of a reader's payload, each as JSON lines in a folder of its own; only an earlier export is replaced."""
    spark = next(iter(parts.values())).sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at) and len(fs.listStatus(at)) and not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/imoveis")):
        raise ValueError(f"{path} is not empty and no earlier export")
    for name, df in parts.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")


def refresh_url(env: dict[str, str]) -> str | None:
    """The page where a hosted export is made again: server, repository and workflow from the environment, or none."""
    ref = env.get("GITHUB_WORKFLOW_REF", "")
    file = ref.partition("/.github/workflows/")[2].partition("@")[0]
    server, repo = env.get("GITHUB_SERVER_URL"), env.get("GITHUB_REPOSITORY")
    return f"{server}/{repo}/actions/workflows/{file}" if server and repo and file else None
