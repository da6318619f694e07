"""Katz backoff language model of any order, learnt from and evaluated over all documents.

Tokens are lower-cased words and one end for each document. Counts of every order are Good-Turing
discounted up to ``K``; the mass so freed at the word level is one unknown word's, the mass freed in
a history is spread over the words not seen after it in proportion to their probability one order
below, with backoff weights that normalise exactly. Before a document stand as many starts as a
history needs. No n-gram of the training documents is left out.

The tables (n-grams of each order with counts, histories with their sums) are partitioned by key
hash; no task or driver holds one whole. Documents stay in blocks, stored once as token numbers over
the block's own vocabulary. A block sends each distinct key once, with its count, in ascending order
as differences, cut into planes of bytes of which the highest are nearly all zero and compress. What
comes back are values in the order sent, without keys: zero where no other block has the key (then
the block's own count is the corpus's). So an n-gram that a third of all tokens are crosses the
network once a block. An n-gram of which a part is in no other block is not sent, only its share of
the counts of counts; nor are such a history's sums. An n-gram adds to its history's sums in the
lowest block that has it. Words, then pairs; then for each order its histories' sums, together with
the n-grams one order up; the last pass evaluates the recursion for every token.

Defined cases: null and blank texts are one end token; rows with a null id are learnt from; without
training documents every word is unknown and has probability one; repeated rows count and score
each; long texts are taken whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_FILES, Words, block_files, block_table, blocked, buckets, from_ipc, mix, n_blocks, n_buckets, parts_of, pieces, release, runs, stored, string_buffers, to_ipc
from .langid import held_out

#: Highest count that is discounted, and words of the longest n-gram.
K, ORDER = 5, 2
#: Compressed input bytes aimed at in a block: its tokens take some 25 arrays at once.
BLOCK_BYTES = 5 << 19
END, START = np.uint64(0x454E44), np.uint64(0x5354415254)
_TOKENS = "block int, docs binary, vocabulary binary, stream binary"
_ROW = "bucket int, block int, kind int, keys binary, vals binary, stats array<bigint>"
_LOW = np.uint64((1 << 56) - 1)
_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA5A5A5A5)


def counts_kind(order: int) -> int:
    return 2 * order


def sums_kind(order: int) -> int:
    return 2 * order + 1


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One pair a worker; frames say their size."""
    return zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def planes(vals: np.ndarray, keep: int) -> bytes:
    """The values' bytes turned: all first bytes, then all second bytes, up to ``keep`` of them."""
    return np.ascontiguousarray(np.ascontiguousarray(vals).view(np.uint8).reshape(-1, vals.itemsize)[:, :keep].T).tobytes()


def unturn(blob: bytes, n: int, kind: str) -> np.ndarray:
    """``n`` values of a type from ``planes``; bytes that were not kept are zero."""
    full = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    if n:
        full[:, : len(blob) // n] = np.frombuffer(blob, np.uint8).reshape(-1, n).T
    return full.reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending keys of one bucket without their first byte, which the bucket implies: planes of their differences' bytes, lowest first."""
    low = keys & _LOW
    return planes(np.diff(low, prepend=np.uint64(0)).astype("<u8"), 7)


def unpack_sorted(blob: bytes, bucket: int, n: int) -> np.ndarray:
    """The keys of ``pack_sorted`` in bucket ``bucket`` of ``n`` (256 or more)."""
    return np.cumsum(unturn(blob, len(blob) // 7, "<u8"), dtype=np.uint64) | np.uint64((bucket << 8) // n) << np.uint64(56)


def narrow(vals: np.ndarray) -> bytes:
    """Values as compressed bytes; of whole numbers, as many planes as the largest needs."""
    if vals.dtype == np.int64:
        raw = planes(vals.astype("<u8"), max(1, (int(vals.max(initial=0)).bit_length() + 7) // 8))
    else:
        raw = np.ascontiguousarray(vals).tobytes()
    return _zstd()[0].compress(raw)


def widen(blob: bytes, n: int, kind: int) -> np.ndarray:
    """``n`` values from ``narrow``: whole counts, or (odd kinds) a history's two sums."""
    raw = _zstd()[1].decompress(blob)
    return np.frombuffer(raw, np.complex128) if kind % 2 else unturn(raw, n, "<u8").astype(np.int64)


def _table(rows: list[tuple]) -> pa.Table:
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["bucket", "block", "kind", "keys", "vals", "stats"])


def tokenized(block: int, table: pa.Table, parts: int, rest: int) -> pa.Table:
    """A block's row of the token table: ids, folds and lengths of its documents, the words' hashes, and the tokens as places among these."""
    data, off = string_buffers(table.column("text"))
    ids = pc.cast(table.column("doc_id"), pa.string()).to_pylist()
    held = [x is not None and zlib.crc32(x.encode()) % parts == rest for x in ids]
    tokens, lengths = [], []
    for i, j in pieces(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        n = w.counts + 1
        inner = np.ones(int(n.sum()), bool)
        inner[np.cumsum(n) - 1] = False
        t = np.full(len(inner), END, np.uint64)
        t[inner] = w.hash
        tokens.append(t)
        lengths.append(n)
    words, at = np.unique(np.concatenate([*tokens, [START]]), return_inverse=True)
    docs = pa.table({"doc_id": table.column("doc_id"), "held": pa.array(held, pa.bool_()), "length": pa.array(np.concatenate(lengths) if lengths else np.zeros(0, np.int64), pa.int64())})
    return pa.table({"block": pa.array([block], pa.int32()), "docs": pa.array([to_ipc(docs)], pa.binary()), "vocabulary": pa.array([planes(np.diff(words, prepend=np.uint64(0)).astype("<u8"), 8)], pa.binary()), "stream": pa.array([narrow(at[:-1].astype(np.int64))], pa.binary())})


class Level:
    """A block's n-grams of one order: distinct keys in ascending order, the starts' among them.

    ``at`` has each token's n-gram, ``history`` and ``tail`` each key's n-gram one order below without
    its last and without its first word, ``place`` a token that it ends at (none for the starts).
    """

    def __init__(self, keys: np.ndarray, at: np.ndarray, start: int, train: np.ndarray, below: Level | None = None, before: np.ndarray | None = None):
        self.keys, self.at, self.start, self.below, self.before = keys, at, start, below, before
        self.own = np.bincount(at, train, len(keys)).astype(np.int64)
        self.place = np.zeros(len(keys), np.int32)
        self.place[at[::-1]] = np.arange(len(at) - 1, -1, -1, dtype=np.int32)
        self.send = np.ones(len(keys), bool)
        if below is not None and len(at):
            self.history, self.tail = before[self.place], below.at[self.place]
            self.send = below.shared[self.history] & below.shared[self.tail] & (below.past[self.history] > 0) & (below.count[self.tail] > 0)
            self.send[start] = True

    def settle(self, back: np.ndarray, starts: int) -> None:
        """Take the corpus's counts: ``back`` has twice the count and one more, one more yet for the lowest block, or zero, of every key sent."""
        self.count, self.shared, self.lead = self.own.copy(), np.zeros(len(self.keys), bool), np.ones(len(self.keys), bool)
        at = np.flatnonzero(self.send)[back > 0]
        back = back[back > 0] - 1
        self.count[at], self.shared[at], self.lead[at] = back >> 1, True, back & 1 == 1
        self.past = self.count.copy()  # as a history
        self.past[self.start] = starts


class Block:
    """A block's documents as tokens with their n-grams."""

    def __init__(self, rows: pa.Table):
        row = rows.to_pylist()[0]
        self.number = row["block"]
        docs = from_ipc([row["docs"]])
        self.ids, self.held, self.lengths = docs.column("doc_id"), np.asarray(docs.column("held"), bool), np.asarray(docs.column("length"))
        words = np.cumsum(unturn(row["vocabulary"], len(row["vocabulary"]) // 8, "<u8"), dtype=np.uint64)
        n = int(self.lengths.sum())
        self.doc = np.repeat(np.arange(len(self.held), dtype=np.int32), self.lengths)
        self.train = ~self.held[self.doc]
        self.first = np.cumsum(self.lengths) - self.lengths
        self.levels = [Level(words, widen(row["stream"], n, 0).astype(np.int32), int(np.searchsorted(words, START)), self.train)]

    def rise(self) -> None:
        """Add the n-grams of the next order."""
        low, words = self.levels[-1], self.levels[0]
        before = np.roll(low.at, 1)
        before[self.first] = low.start
        after = mix(words.keys ^ _SALT)
        start = mix(low.keys[[low.start]] * _STEP + after[words.start])
        keys, at = np.unique(np.concatenate([mix((low.keys * _STEP)[before] + after[words.at]), start]), return_inverse=True)
        at = at.astype(np.int32)
        self.levels.append(Level(keys, at[:-1], int(at[-1]), self.train, low, before))


def rows_for(block: int, kind: int, keys: np.ndarray, vals: np.ndarray, n: int) -> list[tuple]:
    """A row for each bucket in which the block has keys."""
    return [(b, block, kind, pack_sorted(keys[i:j]), narrow(vals[i:j]), None) for b, i, j in parts_of(buckets(keys, n))]


def returned(keys: np.ndarray, back: dict[tuple[int, int], bytes], kind: int, n: int) -> np.ndarray:
    """What came back for keys sent, zero where nothing did."""
    out = np.zeros(len(keys), np.complex128 if kind % 2 else np.int64)
    for b, i, j in parts_of(buckets(keys, n)):
        if (kind, b) in back:
            out[i:j] = widen(back[kind, b], j - i, kind)
    return out


def count_counts(total: np.ndarray) -> list[int]:
    """Keys seen 1 to K+1 times, all occurrences, all keys seen."""
    seen = total[total > 0]
    return [*np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[1 : K + 2].tolist(), int(seen.sum()), len(seen)]


def gathered(key: tuple, rows: pa.Table, n: int) -> pa.Table:
    """Reducer of a bucket: for each row its values in the order sent, and the counts of counts of each order."""
    bucket = key[0].as_py()
    rows = rows.sort_by([("kind", "ascending"), ("block", "ascending")])
    kinds = rows.column("kind").to_numpy()
    out: list[tuple] = []
    for kind, i, j in parts_of(kinds):
        part = rows.slice(i, j - i)
        blocks = part.column("block").to_pylist()
        keys = [unpack_sorted(x, bucket, n) for x in part.column("keys").to_pylist()]
        sizes = [len(x) for x in keys]
        vals = np.concatenate([widen(x, m, kind) for x, m in zip(part.column("vals").to_pylist(), sizes, strict=True)])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        begin = runs(keys[order])
        many = np.diff(np.append(begin, len(keys)))
        total = np.add.reduceat(vals[order], begin) if len(begin) else vals
        back = np.empty_like(vals)
        if kind % 2:
            back[order] = np.repeat(total, many)
        else:
            got = np.where(np.repeat(many > 1, many), np.repeat(total, many) * 2 + 1, 0)
            got[begin[many > 1]] += 1
            back[order] = got
            stats = [sum(x) for x in zip(count_counts(total), *[x for x in part.column("stats").to_pylist() if x], strict=True)]
            out.append((bucket, -1, kind, None, None, stats))
        ends = np.cumsum(sizes)
        out += [(bucket, b, kind, None, narrow(back[e - m : e]), None) for b, e, m in zip(blocks, ends, sizes, strict=True) if back[e - m : e].any()]
    return _table(out)


def discounts(n: list[int]) -> np.ndarray:
    """Katz's Good-Turing ratios for counts 0 to K from the numbers of types seen 1 to K+1 times.

    Where these give no ratio in (0, 1) (small or odd corpora), r / (r + 0.5) is taken.
    """
    d = np.ones(K + 1)
    common = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        ratio = -1.0
        if n[r - 1] and n[r] and common < 1:
            ratio = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
        d[r] = ratio if 0 < ratio < 1 else r / (r + 0.5)
    return d


class Model:
    """The scalars of a trained model: totals, discounts of each order, training documents."""

    def __init__(self, word_stats: list[int], starts: int):
        *n, self.total, self.types = word_stats
        self.starts = starts
        self.d = {1: discounts(n)}
        kept = sum(r * c * self.d[1][r] for r, c in enumerate(n[:K], 1)) + self.total - sum(r * c for r, c in enumerate(n[:K], 1))
        self.unknown = 1 - kept / self.total if self.total else 1.0
        self.scale = 1.0
        if self.total and self.unknown < 1e-12:
            self.unknown, self.scale = 1 / (self.total + 1), self.total / (self.total + 1)

    def word(self, c: np.ndarray) -> np.ndarray:
        """Word-level probability by training count; an unseen word is the unknown word."""
        if not self.total:
            return np.ones(len(c))
        return np.where(c > 0, self.cut(1, c) / self.total * self.scale, self.unknown)

    def cut(self, order: int, c: np.ndarray) -> np.ndarray:
        """Discounted count."""
        return self.d[order][np.minimum(c, K) * (c <= K)] * c

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.types + 1))


def weights(count: np.ndarray, discounted: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor of seen n-grams, backoff weight) by a history's count, discounted sum and its seen words' mass one order below."""
    count = np.maximum(count, 1)
    left = 1 - discounted / count
    full = left < 1e-12
    factor = np.where(full, count / (count + 1), 1.0)
    left = np.where(full, 1 / (count + 1), left)
    return factor, left / np.maximum(1 - below, 1e-300)


def own_sums(level: Level, order: int, p: np.ndarray, model: Model) -> np.ndarray:
    """What the block adds to each history's sums (discounted counts, and as imaginary part their mass one order below)."""
    mine = np.flatnonzero(level.lead & (level.count > 0))
    h, m = level.history[mine], len(level.below.keys)
    return np.bincount(h, model.cut(order, level.count[mine]), m) + 1j * np.bincount(h, p[level.place[mine]], m)


def asked(level: Level) -> np.ndarray:
    """The histories whose sums other blocks add to."""
    used = np.zeros(len(level.below.keys), bool)
    used[level.before] = True
    return np.flatnonzero(used & level.below.shared & (level.below.past > 0))


def recur(block: Block, back: dict, model: Model, n: int, counted: int, summed: int) -> np.ndarray:
    """Each token's probability by orders up to ``summed``; the block's n-grams of orders up to ``counted`` get the corpus's counts."""
    p = np.zeros(0)
    for order in range(1, counted + 1):
        if order > 1:
            block.rise()
        level = block.levels[-1]
        level.settle(returned(level.keys[level.send], back, counts_kind(order), n), model.starts)
        if order == 1:
            p = model.word(level.count[level.at])
        elif order <= summed and len(level.at):
            sums = own_sums(level, order, p, model)
            at = asked(level)
            sums[at] = returned(level.below.keys[at], back, sums_kind(order), n)
            past = level.below.past
            factor, alpha = weights(past, sums.real, sums.imag)
            c, h = level.count[level.at], level.before
            p = np.where(past[h] > 0, np.where(c > 0, factor[h] * model.cut(order, c) / np.maximum(past[h], 1), alpha[h] * p), p)
    return p


def score(docs: DataFrame, parts: int = 10, rest: int = 0, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Documents whose id's crc32 modulo ``parts`` is ``rest`` are held out of training. ``order`` is the
    length of the longest n-gram, two at least.
    """
    if order < 2:
        raise ValueError("the order is two at least")
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = n_blocks(docs, BLOCK_BYTES)
    n = n_buckets(count)

    def tokenize(key: tuple, rows: pa.Table) -> pa.Table:
        return tokenized(key[0].as_py(), block_table(rows), parts, rest)

    dealt = blocked(docs, ("doc_id", "text"), count).repartition(min(count, MOST_FILES), "block")
    blocks = block_files(dealt.groupBy("block").applyInArrow(tokenize, _TOKENS), count)
    release(spark)
    # a start comes before as many tokens as there are training documents
    starts = docs.select("doc_id").where(~held_out(parts, rest)).count()

    def returns(rows: pa.Table) -> dict:
        return {(k, b): v for k, b, v in zip(*[rows.column(c).to_pylist() for c in ("kind", "bucket", "vals")], strict=True)}

    def grams(block: Block, up: int) -> list[tuple]:
        """The n-grams of order ``up`` to send, and the counts of counts of the others."""
        if up > 1:
            block.rise()
        level = block.levels[-1]
        alone = (block.number % n, block.number, counts_kind(up), b"", narrow(np.zeros(0, np.int64)), count_counts(level.own[~level.send]))
        return [*rows_for(block.number, counts_kind(up), level.keys[level.send], level.own[level.send], n), alone]

    def send_words(key: tuple, rows: pa.Table) -> pa.Table:
        return _table(grams(Block(rows), 1))

    def sender(model: Model, summed: int, up: int):
        """Sends the sums of order ``summed`` (none for 1) and the n-grams of order ``up`` (none for 0)."""

        def send(key: tuple, rows: pa.Table, back: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return _table([])
            block, out = Block(rows), []
            p = recur(block, returns(back), model, n, summed, summed - 1)
            level = block.levels[-1]
            if summed > 1 and len(level.at):
                at = asked(level)
                out += rows_for(block.number, sums_kind(summed), level.below.keys[at], own_sums(level, summed, p, model)[at], n)
            return _table(out + (grams(block, up) if up else []))

        return send

    def gather(sent: DataFrame, what: int) -> tuple[DataFrame, list[int]]:
        got = stored(sent.groupBy("bucket").applyInArrow(lambda key, rows: gathered(key, rows, n), _ROW), "katz")
        release(spark)
        stats = {r["pos"]: r["n"] for r in got.where(f"block = -1 AND kind = {what}").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
        return got.where("block >= 0").select("bucket", "block", "kind", "vals"), [int(stats.get(i, 0)) for i in range(K + 3)]

    back, stats = gather(blocks.groupBy("block").applyInArrow(send_words, _ROW), counts_kind(1))
    model = Model(stats, starts)
    for level in range(1, order + 1):
        up = level + 1 if level < order else 0
        more, stats = gather(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(sender(model, level, up), _ROW), counts_kind(up))
        back = back.unionByName(more)
        if up:
            model.d[up] = discounts(stats[: K + 1])

    def final(rows: pa.Table, back: pa.Table) -> pa.Table:
        block = Block(rows)
        p = recur(block, returns(back), model, n, order, order)
        words = block.levels[0]
        c, docs_n = words.count[words.at], len(block.held)
        add = lambda x: np.bincount(block.doc, x, docs_n)
        base = add(np.log10(model.base(c))) if model.total else np.zeros(docs_n)
        return pa.table([block.ids, pa.array(block.held), pa.array(block.lengths, pa.int64()), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(docs_n, model.total), pa.int64()), pa.array(base), pa.array(add(np.log10(p)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(final, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
