"""What the text operators share: word hashing over Arrow buffers, blocks of documents, and
the shared folder for intermediate tables.

A *word* is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return. All hashing is vectorised: a word's hash is a polynomial over its bytes
modulo 2**64, taken from one prefix sum over the whole buffer and then mixed; a window's hash
is the same construction over word hashes. No Python object is made per word.

A *block* is a range of ids holding about ``BLOCK_BYTES`` of text. Blocks are numbered in id
order, so "occurs in an earlier document" becomes "occurs in a lower block, or earlier in the
same block", and a value that many documents share crosses the network once per block that
holds it rather than once per document.
"""

from __future__ import annotations

import contextlib
import gc
import math
import os
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed input bytes aimed at in a block; a session's spark.lotewise.blockBytes comes before it. What a worker
#: needs at once is some 30 times as much: with 4 GB a core, blocks of 64 MB are right for inputs of many terabytes.
BLOCK_BYTES = 3 << 20
#: Blocks whose keys one reducer call holds together, on average, once there are 4096 blocks.
BUCKET_BLOCKS = 4
#: Files of a stored block table, at most (Spark refuses tables of more than 100,000 buckets).
MOST_FILES = 50_000
#: Text bytes worked on at once; a longer single text is one piece.
PIECE_BYTES = 2 << 20
#: Rows and bytes in an Arrow batch handed to Python: whichever is reached first; a longer row is a batch.
BATCH_ROWS, BATCH_BYTES = 2000, 64 << 20
#: Has workers give large arrays back to the system when they are freed, so that idle ones stay small.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WS = np.zeros(256, bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers of this session, and say where they find this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env, home = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):  # workers import this package from where the driver did
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)
    for k, v in WORKER_ENV.items():
        env.setdefault(k, v)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests, one machine) /tmp/checkpoints is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{at.rstrip('/')}/lotewise/{what}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """While it lasts, a write drops its shuffle files at its end: only for plans that nothing reads again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    with dropping_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """Words of consecutive texts: byte ranges, a hash each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool):
        self.data, self.off = data, off
        n = len(data)
        ws = _WS[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        begin = ~ws
        end = begin.copy()
        begin[1:] &= ws[:-1] | edge[1:n]
        end[:-1] &= ws[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, off)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of words i to i+k-1 for every i (also across texts; see ``inside``)."""
        h = self.hash if not salt else mix(self.hash ^ np.uint64(salt))
        n = len(h)
        if n < k:
            return np.zeros(0, np.uint64)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k))

    def inside(self, k: int) -> np.ndarray:
        """For every window start, the index of the text that holds it whole, else -1."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(self.off) - 1), self.counts)
        return np.where(doc[: n - k + 1] == doc[k - 1 :], doc[: n - k + 1], -1)


def pack(keys: np.ndarray, width: int) -> bytes:
    """The top ``width`` bytes of 64-bit keys."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return full.reshape(-1).view(">u8").astype(np.uint64)


def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def from_ipc(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def n_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for ``df``: from the optimizer's estimate of its size, and as many as cores at least.

    Where there is no estimate (a plan that Spark cannot size), one block for each shuffle partition.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    block_bytes = int(spark.conf.get("spark.lotewise.blockBytes", str(block_bytes)))
    return max(spark.sparkContext.defaultParallelism, math.ceil(size / block_bytes))


def place(ids: np.ndarray, none: np.ndarray, texts: pa.Array, bounds: np.ndarray, last: int) -> np.ndarray:
    """Block of each row: its range of ids; ids that fill several ranges, and null ids, are spread by text.

    ``bounds`` may repeat a value: as often as it fills a whole range. Null ids have ``last`` blocks
    of their own after the others.
    """
    low, at = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    low, wide = np.minimum(low + 1, at), at - low
    low[none], wide[none] = len(bounds) + 1, last
    at[none] = len(bounds) + 1
    for i in np.flatnonzero(wide > 1).tolist():
        at[i] = low[i] + zlib.crc32((texts[i].as_py() or "").encode()) % int(wide[i])
    return at


def blocked(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text"), blocks: int | None = None) -> DataFrame:
    """(block, blob): ``docs`` dealt into about ``blocks`` blocks by ranges of the first column; null ids go last.

    A blob is a compressed Arrow stream with the rows that one input batch has for the block. Rows of
    an id (or of none) that fills more than a block go by their text to several, so only equal rows
    must share one.
    """
    key = columns[0]
    docs = docs.select(*columns)
    n = blocks or n_blocks(docs)
    got = docs.agg(F.percentile_approx(F.col(key).cast("long"), [i / n for i in range(1, max(2, n))], max(10_000, 4 * n)).alias("q"), F.count(key).alias("known"), F.count(F.lit(1)).alias("all")).first()
    bounds = np.array(sorted(got["q"] or [])[: n - 1], np.int64)
    last = max(1, math.ceil(n * (got["all"] - got["known"]) / max(got["all"], 1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ids = b.column(key).cast(pa.int64())
            at = place(np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_null()), b.column("text"), bounds, last)
            order = np.argsort(at, kind="stable")
            found, begin = np.unique(at[order], return_index=True)
            ends = [*begin[1:], len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([to_ipc(t.take(pa.array(order[i:j]))) for i, j in zip(begin, ends, strict=True)], pa.binary())], names=["block", "blob"])

    return docs.mapInArrow(deal, "block int, blob binary")


def block_table(rows: pa.Table, key: str = "doc_id") -> pa.Table:
    """The rows of one block, in the order of ids (null last), then of texts."""
    t = from_ipc(rows.column("blob").to_pylist())
    by = [(c, "ascending") for c in t.column_names]
    return t.take(pc.sort_indices(t, sort_keys=by, null_placement="at_end"))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in a sorted array."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key: equal ranges of the key space, in key order."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts in which everything but letters of any script is a space.

    Each text begins and ends with a space, so that n-grams see word ends. Bytes of characters
    beyond ASCII count as letters.
    """
    data, off = string_buffers(pc.utf8_lower(col.cast(pa.large_string())))
    n = len(off) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    if len(data):
        at = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(off))
        out[at] = _FOLD[data]
    return out, off + 2 * np.arange(n + 1)


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Mixed 64-bit hash of every run of n bytes (n up to 8)."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = data[:size].astype(np.uint64)
    for i in range(1, n):
        h <<= np.uint64(8)
        h |= data[i : i + size]
    h ^= np.uint64(n << 60)
    return mix(h)


def gram_docs(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts at ``off``: first gram of each text and how many it has."""
    return off[:-1], np.maximum(np.diff(off) - n + 1, 0)


_FOLD_DIGITS = _FOLD.copy()
_FOLD_DIGITS[48:58] = np.arange(48, 58)


def byte_case_fold(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts in which all but letters and digits is a space."""
    data, off = string_buffers(pc.utf8_lower(col.cast(pa.large_string())))
    return _FOLD_DIGITS[data], off


def n_buckets(blocks: int) -> int:
    """Ranges of the key space that a reducer takes one at a time: a power of two, 1024 at least.

    A block sends one row for each range in which it has keys. Up to ``1024 * BUCKET_BLOCKS`` blocks
    rows grow as the input; beyond, a row holds fewer keys, down to one, and never more rows than keys
    are sent. Larger blocks (spark.lotewise.blockBytes) move that point: rows go with their square.
    """
    return 1 << max(10, (-(-blocks // BUCKET_BLOCKS) - 1).bit_length())


def pack_low(keys: np.ndarray, width: int) -> bytes:
    """``width`` bytes of each key after its first, which the bucket implies (there are 256 buckets or more)."""
    return pack(keys << np.uint64(8), width)


def unpack_low(blob: bytes, width: int, bucket: int, n: int) -> np.ndarray:
    first = np.uint64((bucket << 8) // n) << np.uint64(56)
    return (unpack(blob, width) >> np.uint64(8)) | first


def block_files(blocks: DataFrame, count: int) -> DataFrame:
    """A (block, ...) table bucketed by block in the shared warehouse: later passes group it without a shuffle."""
    spark = blocks.sparkSession
    name = f"lotewise_blocks_{uuid.uuid4().hex}"
    with dropping_shuffles(spark):
        blocks.write.bucketBy(min(count, MOST_FILES), "block").format("parquet").saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are no longer in use: it does so when the JVM finds them unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_of(own: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) for runs of a sorted array."""
    cut = np.append(runs(own), len(own))
    return [(int(own[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:], strict=True)]
