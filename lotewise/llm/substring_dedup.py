"""Removal of word spans that repeat an earlier place of the corpus.

Every window of ``LENGTH`` words that also starts earlier (in a smaller id, or before in the same
document) is covered; covered words go. Windows are judged on the input. A maximal matched span
of at least ``LENGTH`` words is a run of such windows, so the words removed are those of the
maximal spans above the threshold, as matching statistics against all earlier text give them.

The matching statistics are not taken from broadcast suffix automata: the reference of a document is
the whole corpus before it, so automata of all reference shards would have to be built, broadcast
and streamed over by every document, which grows with the square of the corpus (not measured).
Instead, blocks of documents in id order exchange window hashes once: each block sends its
distinct windows (72 bits each) to reducers by hash range, and gets back those that a lower block
has. A window shared by very many documents crosses the network once a block. ``SuffixAutomaton``
serves the case that the method fits: a given reference (``remove_reference``), in shards of bounded size.

Defined cases: null text has no words; texts shorter than a window are kept whole; of equal rows
the first in (id, text) order is kept and the others lose what it has; null ids order last; an
empty table gives an empty result; long texts are treated whole. ``dedup`` keeps other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, block_table, blocked, buckets, n_blocks, n_buckets, pack_low, pieces, runs, stored, string_buffers, unpack_low

#: Words of a window.
LENGTH = 20
#: Bytes of a reference shard, whose automaton is broadcast.
REFERENCE_BYTES = 4 << 20
_SALT = 0x5DEECE66D
_KEYS = "bucket int, block int, keys binary, checks binary"


class _Block:
    """Window keys of a block's documents, in order."""

    def __init__(self, table: pa.Table, length: int):
        keys, checks, starts, counts, base = [], [], [], [], 0
        data, off = string_buffers(table.column("text"))
        for i, j in pieces(off):
            w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=False)
            ok = w.inside(length) >= 0
            keys.append(w.windows(length)[ok])
            checks.append((w.windows(length, _SALT)[ok] >> np.uint64(56)).astype(np.uint8))
            starts.append(np.flatnonzero(ok) + base)
            counts.append(w.counts)
            base += len(w.hash)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.keys, self.checks = join(keys, np.uint64), join(checks, np.uint8)
        self.starts, self.counts, self.words = join(starts, np.int64), join(counts, np.int64), base
        self.order = np.argsort(self.keys, kind="stable")
        k, c = self.keys[self.order], self.checks[self.order]
        self.first = np.ones(len(k), bool)
        if len(k):
            self.first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])


def repeated_elsewhere(blocks: DataFrame, count: int, length: int) -> DataFrame:
    """(block, bucket, keys, checks): the windows of each block that a lower block has."""
    n = n_buckets(count)

    def emit(key: tuple, rows: pa.Table) -> pa.Table:
        b = _Block(block_table(rows), length)
        at = b.order[b.first]
        keys, checks = b.keys[at], b.checks[at]
        own = buckets(keys, n)
        cut = np.append(runs(own), len(own))
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table([pa.array([int(own[i]) for i, _ in parts], pa.int32()), pa.array([key[0].as_py()] * len(parts), pa.int32()), pa.array([pack_low(keys[i:j], 7) for i, j in parts], pa.binary()), pa.array([checks[i:j].tobytes() for i, j in parts], pa.binary())], names=["bucket", "block", "keys", "checks"])

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows = rows.sort_by("block")
        ids = rows.column("block").to_pylist()
        keys = [unpack_low(x, 7, bucket, n) for x in rows.column("keys").to_pylist()]
        checks = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("checks").to_pylist()])
        block = np.repeat(ids, [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        k, c, b = keys[order], checks[order], block[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        owner = b[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
        late = b > owner
        k, c, b = k[late], c[late], b[late]
        by = np.argsort(b, kind="stable")
        k, c, b = k[by], c[by], b[by]
        cut = np.append(runs(b), len(b))
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table([pa.array([bucket] * len(parts), pa.int32()), pa.array([int(b[i]) for i, _ in parts], pa.int32()), pa.array([pack_low(k[i:j], 7) for i, j in parts], pa.binary()), pa.array([c[i:j].tobytes() for i, j in parts], pa.binary())], names=["bucket", "block", "keys", "checks"])

    return blocks.groupBy("block").applyInArrow(emit, _KEYS).groupBy("bucket").applyInArrow(reduce, _KEYS)


def covered(table: pa.Table, back: pa.Table, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each document, whether each word goes) for a block and what its reducers sent back."""
    b = _Block(table, length)
    gone = np.zeros(len(b.keys), bool)
    gone[b.order] = ~b.first
    if back.num_rows:
        parts = sorted(zip(*[back.column(c).to_pylist() for c in ("bucket", "keys", "checks")], strict=True))
        keys = np.concatenate([unpack_low(k, 7, p, n) for p, k, _ in parts])
        checks = np.concatenate([np.frombuffer(c, np.uint8) for _, _, c in parts])
        at = np.minimum(np.searchsorted(keys, b.keys), len(keys) - 1)
        gone |= (keys[at] == b.keys) & (checks[at] == b.checks)
    edge = np.zeros(b.words + 1, np.int64)
    s = b.starts[gone]
    np.add.at(edge, s, 1)
    np.add.at(edge, s + length, -1)
    return b.counts, np.cumsum(edge[:-1]) > 0


def _apply(docs: DataFrame, columns: tuple[str, ...], schema: str, build: Callable, length: int) -> DataFrame:
    count = n_blocks(docs.select(*columns))
    blocks = blocked(docs, columns, count)
    back = repeated_elsewhere(blocks, count, length)
    n = n_buckets(count)

    def final(rows: pa.Table, found: pa.Table) -> pa.Table:
        table = block_table(rows)
        counts, gone = covered(table, found, length, n)
        ends = np.cumsum(counts)
        removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[np.concatenate(([0], ends))])
        return build(table, counts, removed, gone, ends)

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(final, schema)


def kept_words(text: str | None, gone: np.ndarray) -> list[bytes]:
    """The words of a text that stay."""
    words = (text or "").encode().split()
    return list(compress(words, (~gone).tolist())) if gone.any() else words


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""

    def build(t: pa.Table, counts: np.ndarray, removed: np.ndarray, gone: np.ndarray, ends: np.ndarray) -> pa.Table:
        sha = [hashlib.sha256(b" ".join(kept_words(x, gone[e - c : e]))).hexdigest() for x, c, e in zip(t.column("text").to_pylist(), counts.tolist(), ends.tolist(), strict=True)]
        return pa.table([t.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _apply(docs, ("doc_id", "text"), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string", build, length)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated spans taken out of ``text``; a text that loses nothing is unchanged, another is its kept words joined by spaces."""
    names = docs.columns
    columns = ("doc_id", *[c for c in names if c != "doc_id"])

    def build(t: pa.Table, counts: np.ndarray, removed: np.ndarray, gone: np.ndarray, ends: np.ndarray) -> pa.Table:
        texts = t.column("text").to_pylist()
        for i in np.flatnonzero(removed).tolist():
            texts[i] = b" ".join(kept_words(texts[i], gone[ends[i] - counts[i] : ends[i]])).decode("utf-8", "replace")
        return t.set_column(t.column_names.index("text"), "text", pa.array(texts, pa.string())).select(names)

    return _apply(docs, columns, docs.schema, build, length)


class SuffixAutomaton:
    """All factors of a sequence of word ids, with matching statistics of another sequence."""

    def __init__(self, words: list[int]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for w in words:
            new = len(self.go)
            self.go.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            p = last
            while p >= 0 and w not in self.go[p]:
                self.go[p][w] = new
                p = self.link[p]
            if p >= 0:
                q = self.go[p][w]
                if self.size[q] == self.size[p] + 1:
                    self.link[new] = q
                else:
                    copy = len(self.go)
                    self.go.append(dict(self.go[q]))
                    self.link.append(self.link[q])
                    self.size.append(self.size[p] + 1)
                    while p >= 0 and self.go[p].get(w) == q:
                        self.go[p][w] = copy
                        p = self.link[p]
                    self.link[q] = self.link[new] = copy
            last = new

    def statistics(self, words: list[int]) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        at, length, out = 0, 0, []
        for w in words:
            while at and w not in self.go[at]:
                at = self.link[at]
                length = self.size[at]
            if w in self.go[at]:
                at, length = self.go[at][w], length + 1
            else:
                length = 0
            out.append(length)
        return out


def reference_shards(reference: list[str], length: int = LENGTH, most: int = REFERENCE_BYTES) -> Iterator[list[list[bytes]]]:
    """The reference's words in shards of about ``most`` bytes at most; a text that is cut overlaps by a window less a word."""
    shard: list[list[bytes]] = []
    room = most
    for text in reference:
        words = (text or "").encode().split()
        begin = 0
        while begin < len(words):
            size, end = 0, begin
            while end < len(words) and (size < room or end - begin < length):
                size += len(words[end]) + 1
                end += 1
            shard.append(words[begin:end])
            room -= size
            begin = end if end == len(words) else end - length + 1
            if room <= 0:
                yield shard
                shard, room = [], most
    if shard:
        yield shard


def remove_reference(docs: DataFrame, reference: list[str], length: int = LENGTH, most: int = REFERENCE_BYTES) -> DataFrame:
    """``docs`` (doc_id, text) without spans of ``length`` words or more that a reference has.

    The reference is cut into shards of at most ``most`` bytes. One automaton over a shard, a boundary after
    each text, is broadcast; documents stream over it and note which words it covers; what is noted is
    stored between shards, so executors hold one automaton. At last the words noted go.
    """
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    noted = docs.select("doc_id", "text", F.lit(b"").alias("gone"))
    for n, shard in enumerate(reference_shards(reference, length, most)):
        ids: dict[bytes, int] = {}
        words: list[int] = []
        for i, t in enumerate(shard):
            words += [ids.setdefault(w, len(ids)) for w in t]
            words.append(-1 - i)
        shared = sc.broadcast((ids, SuffixAutomaton(words)))

        def note(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, automaton = shared.value
            for b in batches:
                out = []
                for t, before in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                    own = (t or "").encode().split()
                    edge = np.zeros(len(own) + 1, np.int64)
                    for end, m in enumerate(automaton.statistics([known.get(w, 1 << 62) for w in own]), 1):
                        if m >= length:
                            edge[end - m] += 1
                            edge[end] -= 1
                    gone = np.cumsum(edge)[:-1] > 0
                    if before:
                        gone |= np.frombuffer(before, bool)
                    out.append(gone.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(out, pa.binary())], names=["doc_id", "text", "gone"])

        noted = noted.mapInArrow(note, f"doc_id {kind}, text string, gone binary")
        if n:
            noted = stored(noted, "reference")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = [np.frombuffer(g or b"", bool) for g in b.column("gone").to_pylist()]
            texts = b.column("text").to_pylist()
            out = [t if not g.any() else b" ".join(kept_words(t, g)).decode("utf-8", "replace") for t, g in zip(texts, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return noted.mapInArrow(drop, f"doc_id {kind}, text string")
