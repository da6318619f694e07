"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits; in scripts without spaces each character is a word.
All word trigrams of a benchmark item are its seeds, however common. Where a document has a seed, the
surrounding passage is aligned with the item word by word; the score is the best local alignment's
share of a perfect one. Passages with too few of the item's words to reach ``THRESHOLD`` by any
alignment are not aligned, which loses none. Common seeds are bounded, not left out: a text whose seeds meet more
than ``TOGETHER`` places of items is first held against each of these items by the words that they share at all, and
what then is left goes on in parts of that size. Items of fewer than ``LEAST_WORDS`` words are searched
for as exact word sequences.

The benchmark is broadcast in chunks of at most ``CHUNK_BYTES`` bytes of text (or one item), one pass
over the documents for each chunk. Documents are never shuffled.

Defined cases: null items and items without a word are not searched for; equal items count once; null
and empty documents leak nothing; one row for each leaking document row and item, so repeated rows,
null ids among them, give repeated rows; an empty benchmark finds nothing; long texts are read whole;
extra columns are kept by ``clean`` and ignored by ``find``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, byte_case_fold, pieces, runs, string_buffers

SEED = 3
LEAST_WORDS = 5
#: Share of a perfect alignment's score from which a passage counts as a copy.
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of item texts in one broadcast, at most: sums are taken per slot of items, and slots packed into chunks.
CHUNK_BYTES = 8 << 20
#: Words beyond the item's length, on either side, that an alignment may use, as a share of it.
SLACK = 0.5
#: Seeds with their items that are held at once; only one text's seeds of one item can be more.
TOGETHER = 1 << 20


def spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with spaces around every character of the scripts written without them (CJK, kana, Thai, Lao, Khmer, Burmese)."""
    if not len(data):
        return data, off
    second = np.append(data[1:], 0)
    wide = (data == 0xF0) & (second >= 0xA0) & (second < 0xB0)
    lead = (data >= 0xE3) & (data <= 0xE9) | wide | (data == 0xEF) & (second >= 0xA4) & (second < 0xAC)
    lead |= (data == 0xE0) & (second >= 0xB8) & (second < 0xBC) | (data == 0xE1) & ((second >= 0x80) & (second < 0x83) | (second >= 0x9E) & (second < 0xA0))
    at = np.flatnonzero(lead)
    if not len(at):
        return data, off
    extra = np.zeros(len(data) + 1, np.int64)
    extra[at] += 1
    np.add.at(extra, at + np.where(wide[at], 4, 3), 1)
    moved = np.cumsum(extra)
    out = np.full(len(data) + int(moved[-1]), 32, np.uint8)
    out[np.arange(len(data)) + moved[:-1]] = data
    return out, off + np.concatenate(([0], moved))[off]


def _words(col: pa.Array) -> Words:
    return Words(*spaced(*byte_case_fold(col)), lower=False)


class Items:
    """Benchmark items ready to search for."""

    def __init__(self, ids: pa.Array | list, texts: list[str]):
        w = _words(pa.array(texts, pa.string()))
        self.ids = ids if isinstance(ids, pa.Array) else pa.array(ids)
        self.words = [w.hash[i:j] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
        keys, owner, place, short = [], [], [], {}
        grams = w.windows(SEED)
        self.kinds = [np.unique(x, return_counts=True) for x in self.words]
        # the same in one piece: words, how often an item has them, where an item's begin, and how many it must share
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.kind = np.concatenate([k for k, _ in self.kinds]) if self.words else np.zeros(0, np.uint64)
        self.most = np.concatenate([n for _, n in self.kinds]) if self.words else np.zeros(0, np.int64)
        self.begin = np.cumsum([0, *[len(k) for k, _ in self.kinds]])
        for n, (i, j) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            if j - i < LEAST_WORDS:
                if j > i:
                    short.setdefault(int(j - i), []).append(n)
                continue
            keys.append(grams[i : j - SEED + 1])
            owner.append(np.full(j - i - SEED + 1, n))
            place.append(np.arange(j - i - SEED + 1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owner = np.concatenate(owner)[order] if keys else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if keys else np.zeros(0, int)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        # items below LEAST_WORDS by their number of words: keys of the whole items, ascending, and whose they are
        self.short = {}
        for size, items in short.items():
            whole = w.windows(size)[w.first[items]]
            by = np.argsort(whole, kind="stable")
            self.short[size] = whole[by], np.array(items)[by]

    def find(self, col: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(row, item, score, seeds, first word, word after the last) of every copy in the texts."""
        w = _words(col)
        return self.aligned(w) + self.exact(w)

    def exact(self, w: Words) -> list[tuple[int, int, float, int, int, int]]:
        """The copies of short items, the first in each text; their seed is the whole item."""
        out = []
        for size, (keys, owner) in self.short.items():
            g, inside = w.windows(size), w.inside(size)
            at = np.flatnonzero((inside >= 0) & np.isin(g, keys))
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            first: dict[tuple[int, int], int] = {}
            for p, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for n in owner[i:j].tolist():
                    first.setdefault((int(inside[p]), n), p)
            out += [(r, n, 1.0, 1, int(p - w.first[r]), int(p - w.first[r]) + size) for (r, n), p in first.items()]
        return out

    def aligned(self, w: Words) -> list[tuple[int, int, float, int, int, int]]:
        """The copies of the other items: seeds, then alignment."""
        if not len(self.keys):
            return []
        g = w.windows(SEED)
        at = np.flatnonzero(self.maybe[g >> np.uint64(44)])
        lo = np.searchsorted(self.keys, g[at], "left")
        n = np.searchsorted(self.keys, g[at], "right") - lo
        row = np.searchsorted(w.first, at, "right") - 1
        ok = (n > 0) & (w.first[row + 1] >= at + SEED)
        at, lo, n, row = at[ok], lo[ok], n[ok], row[ok]
        out, cut = [], runs(row)
        sums = np.add.reduceat(n, cut) if len(cut) else n[:0]
        ends = np.append(cut[1:], len(row))
        few = np.flatnonzero(sums <= TOGETHER)
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(sums[few]) // TOGETHER)) + 1):  # texts together, of up to twice as many places
            if len(part):
                mine = np.isin(row, row[cut[part]])
                out += self.passages(w, at[mine], lo[mine], n[mine])
        for x in np.flatnonzero(sums > TOGETHER).tolist():
            mine = slice(int(cut[x]), int(ends[x]))
            out += self.crowded(w, int(row[cut[x]]), at[mine], lo[mine], n[mine])
        return out

    def crowded(self, w: Words, row: int, at: np.ndarray, lo: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
        """The copies in a text whose seeds meet many places of items."""
        kinds, most = np.unique(w.hash[w.first[row] : w.first[row + 1]], return_counts=True)
        seeds, which = np.unique(lo, return_index=True)
        met = np.zeros(len(self.words), bool)
        for i, m in zip(seeds.tolist(), n[which].tolist(), strict=True):
            met[self.owner[i : i + m]] = True
        some = np.flatnonzero(met)
        # the words that an item and the whole text share are no fewer than those of any passage
        wanted = np.zeros(len(self.words), bool)
        for part in np.array_split(some, 1 + int((self.begin[some + 1] - self.begin[some]).sum()) // TOGETHER):
            if not len(part):
                continue
            long = self.begin[part + 1] - self.begin[part]
            of = np.repeat(self.begin[part] - np.cumsum(long) + long, long) + np.arange(long.sum())
            found = np.minimum(np.searchsorted(kinds, self.kind[of]), len(kinds) - 1)
            both = np.where(kinds[found] == self.kind[of], np.minimum(most[found], self.most[of]), 0)
            shared = np.add.reduceat(both, np.cumsum(long) - long)
            wanted[part[shared >= THRESHOLD * self.size[part]]] = True
        out, some = [], np.flatnonzero(wanted)
        # places of wanted items in front of each place, to count those of a seed without naming them
        total = self.met_by(some, lo, n)
        for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(total) // TOGETHER)) + 1) if len(some) else []:
            only = np.zeros(len(self.words), bool)
            only[part] = True
            out += self.passages(w, at, lo, n, only)
        return out

    def met_by(self, items: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For each item, how many times the seeds at ``lo`` meet one of its places."""
        seeds, times = np.unique(lo, return_counts=True)
        reach = n[np.unique(lo, return_index=True)[1]]
        out = np.zeros(len(self.words), np.int64)
        for i, m, k in zip(seeds.tolist(), reach.tolist(), times.tolist(), strict=True):
            np.add.at(out, self.owner[i : i + m], k)
        return out[items]

    def passages(self, w: Words, at: np.ndarray, lo: np.ndarray, n: np.ndarray, only: np.ndarray | None = None) -> list[tuple[int, int, float, int, int, int]]:
        """The copies around seeds at words ``at``, each of which is at ``n`` places from ``lo`` on; of the items ``only``, if given."""
        if only is None:
            pos = np.repeat(at, n)
            seed = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        else:
            mine = np.flatnonzero(only[self.owner])
            first, last = np.searchsorted(mine, lo), np.searchsorted(mine, lo + n)
            many = last - first
            pos = np.repeat(at, many)
            seed = mine[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
        if not len(pos):
            return []
        row = np.searchsorted(w.first, pos, "right") - 1
        item, begin = self.owner[seed], pos - self.place[seed]
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        size = self.size[item]
        slack = (size * SLACK).astype(np.int64) + 2
        other = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        # seeds on near diagonals share a passage
        p = np.flatnonzero(np.concatenate(([True], other | (np.diff(begin) > slack[1:]))))
        q = np.append(p[1:], len(row)) - 1
        seeds = np.diff(np.append(np.flatnonzero(np.concatenate(([True], other))), len(row)))
        group = np.cumsum(np.concatenate(([0], other)))[p]
        left, right = np.maximum(w.first[row[p]], begin[p] - slack[p]), np.minimum(w.first[row[p] + 1], begin[q] + (size + slack)[p])
        best: dict[int, tuple[float, int, int, int, int]] = {}
        for r, k, u, i, j in zip(row[p].tolist(), item[p].tolist(), group.tolist(), left.tolist(), right.tolist(), strict=True):
            passage = w.hash[i:j]
            if not self.may(passage, k):
                continue
            s, a, b = align(passage, self.words[k])
            if s >= THRESHOLD and (u not in best or s > best[u][2]):
                best[u] = (r, k, s, i - w.first[r] + a, i - w.first[r] + b)
        return [(r, k, s, int(seeds[u]), int(a), int(b)) for u, (r, k, s, a, b) in best.items()]

    def may(self, passage: np.ndarray, item: int) -> bool:
        """Whether the words that passage and item share, all matched without a gap, reach the threshold."""
        kinds, most = self.kinds[item]
        need = THRESHOLD * most.sum()
        if len(passage) < need:
            return False
        at = np.minimum(np.searchsorted(kinds, passage), len(kinds) - 1)
        at = at[kinds[at] == passage]
        return len(at) >= need and np.minimum(np.bincount(at, minlength=len(kinds)), most).sum() >= need


def matrix_end(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local score of words a against b, and where it ends in a; rows over b, vectors over a."""
    n = len(a)
    ramp = -GAP * np.arange(n + 1)
    last = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for x in b:
        row = np.zeros(n + 1, np.int64)
        np.maximum(last[:-1] + np.where(a == x, MATCH, MISMATCH), last[1:] + GAP, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        last = row
    return best, end


def align(passage: np.ndarray, item: np.ndarray) -> tuple[float, int, int]:
    """(score share, first word, word after the last) of the best local alignment."""
    best, end = matrix_end(passage, item)
    if not best:
        return 0.0, 0, 0
    _, back = matrix_end(passage[:end][::-1], item[::-1])
    return best / (MATCH * len(item)), end - back, end


def chunks(benchmark: DataFrame, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.Array, list[str]]]:
    """The benchmark's (ids, texts), at most ``most`` bytes of text, or else one slot of items, at a time."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, math.ceil(16 * total / most)) if total > most else 1
    slot = F.pmod(F.xxhash64("item_id", "text"), F.lit(slots))
    sums = {r["slot"]: r["n"] for r in items.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length("text")).alias("n")).collect()} if slots > 1 else {0: total}
    spans, size = [], most + 1
    for s in sorted(sums):
        if size + sums[s] > most:
            spans.append([s, s])
            size = 0
        spans[-1][1] = s
        size += sums[s]
    for low, high in spans:
        got = items.where(slot.between(low, high)).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        if got.num_rows:
            yield got.column("item_id").combine_chunks(), got.column("text").to_pylist()


def prepared(benchmark: DataFrame) -> Iterator[Items]:
    for ids, texts in chunks(benchmark):
        yield Items(ids, texts)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, first_word, end_word): documents that hold a copy of an item."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, n_seeds int, first_word bigint, end_word bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in prepared(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                _, off = string_buffers(b.column("text"))
                for i, j in pieces(off):
                    got = items.find(b.column("text").slice(i, j - i))
                    if got:
                        r, k, s, n, a, e = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i).take(pa.array(r)), items.ids.take(pa.array(k)), pa.array(s, pa.float64()), pa.array(n, pa.int32()), pa.array(a, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "item_id", "score", "n_seeds", "first_word", "end_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no copy of a benchmark item."""
    out = docs
    for items in prepared(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                _, off = string_buffers(b.column("text"))
                for i, j in pieces(off):
                    keep[[i + x[0] for x in items.find(b.column("text").slice(i, j - i))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out
