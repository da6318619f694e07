"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut by the vocabulary's pattern; the distinct pieces of a batch that the worker has
not met are encoded together. Their bytes form one array of symbols. An index maps every rank
to the positions of its pair in that array; the lowest active rank is taken from a heap, applied
at all its positions at once, and the positions of the pairs so made join the lists of their
ranks. The index is bounded by a batch, the memo of pieces by ``MEMO``; no data is shuffled.

Defined cases: null counts as empty and has no tokens; texts of any length are encoded whole;
repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
Text between special tokens is encoded apart, as the file format prescribes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pieces of a text, as byte-level vocabularies define them (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers before it starts anew.
MEMO = 300_000
#: Text characters encoded together.
TOGETHER = 2 << 20

_codecs: dict[str, Codec] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Codec:
    """A vocabulary file of the tokenizers library, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.left, self.right = keys >> 32, keys & 0xFFFFFFFF
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.ranges = sorted({min(len(pairs), int(16 * 1.25**i)) for i in range(60)})
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        of = {c: b for b, c in enumerate(letters)}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(of[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.memo: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where there is no merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)

    def learn(self, words: list[str]) -> None:
        """Encode the given pieces together and remember them."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        ends = np.cumsum(size)
        n = int(ends[-1]) if len(ends) else 0
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends[size > 0] - 1] = -1
        before[(ends - size)[size > 0]] = -1
        log: list[tuple[np.ndarray, np.ndarray]] = []  # occurrences of ranks beyond the open range
        near: dict[int, list[np.ndarray]] = {}  # occurrences of ranks in the open range
        active: list[int] = []
        bound = 0

        def note(positions: np.ndarray) -> None:
            rank = self.ranks(sym[positions], sym[after[positions]])
            keep = rank >= 0
            rank, positions = rank[keep], positions[keep]
            if len(rank):
                log.append((rank, positions))
                for i in np.flatnonzero(rank < bound).tolist():
                    r = int(rank[i])
                    if r not in near:
                        near[r] = []
                        heapq.heappush(active, r)
                    near[r].append(positions[i : i + 1])

        note(np.flatnonzero(after >= 0))
        for bound in self.ranges:
            if log:  # open the next range: its occurrences leave the log, grouped by rank
                rank, positions = (np.concatenate(x) for x in zip(*log, strict=True))
                now = rank < bound
                log[:] = [(rank[~now], positions[~now])]
                by = np.lexsort((positions[now], rank[now]))
                rank, positions = rank[now][by], positions[now][by]
                cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                near = {int(p[0][0]): [p[1]] for p in zip(np.split(rank, cut), np.split(positions, cut), strict=True) if len(p[0])}
                active = sorted(near)
            while active:
                r = heapq.heappop(active)
                lists = near.pop(r)
                at = np.unique(lists[0] if len(lists) == 1 else np.concatenate(lists))
                a, b = self.left[r], self.right[r]
                nxt = after[at]
                ok = (sym[at] == a) & (nxt >= 0) & (sym[nxt] == b)
                if not ok.all():
                    at, nxt = at[ok], nxt[ok]
                if not len(at):
                    continue
                if a == b and len(at) > 1:  # in a run of equal symbols every other pair, from the left
                    chained = np.concatenate(([False], nxt[:-1] == at[1:]))
                    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    ok = (np.arange(len(at)) - head) % 2 == 0
                    at, nxt = at[ok], nxt[ok]
                far = after[nxt]
                sym[at] = self.made[r]
                sym[nxt] = -1
                after[at] = far
                has = far >= 0
                right = at[has]
                before[far[has]] = right
                left = before[at]
                left = left[left >= 0]
                if len(left) or len(right):
                    note(np.concatenate((left, right)))
        live = sym >= 0
        ids = sym[live].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(live)))[ends] * 4 if n else np.zeros(len(words), np.int64)
        i = 0
        for w, j in zip(words, upto.tolist(), strict=True):
            self.memo[w] = ids[i:j]
            i = j

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= TOGETHER):
                size += len(texts[to] or "")
                to += 1
            out += self._encode(texts[at:to])
            at = to
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts: list[list[tuple[bytes, list[str]]]] = []
        new: dict[str, None] = {}
        for t in texts:
            own: list[tuple[bytes, list[str]]] = []
            for s in self.split.split(t or "") if self.split else [t or ""]:
                if s in self.special:
                    own.append((self.special[s].to_bytes(4, "little"), []))
                elif s:
                    words = self.find(s)
                    new.update(dict.fromkeys(w for w in set(words) if w not in self.memo))
                    own.append((b"", words))
            parts.append(own)
        if new:
            self.learn(list(new))
        of = self.memo.__getitem__
        return [b"".join([i + b"".join(map(of, w)) for i, w in own]) for own in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.size[i]
        ends = np.cumsum(size)
        at = np.repeat(self.begin[i] - ends + size, size)
        at += np.arange(len(at))
        return self.flat[at].tobytes().decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One codec for a worker and path."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = [np.frombuffer(x, "<u4").astype(np.int32) for x in c.encode(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = [None if x is None else c.decode(np.array(x, "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and digests where the text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = c.encode(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
