"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by minimum bin slack.

Texts are tokenised in Arrow batches and cut into pieces of at most ``capacity`` tokens. Which lengths share a
sequence depends on nothing but how many pieces have each length: a table of at most ``capacity`` rows, whatever
the corpus. Over it the driver fills one bin after another: a bitset per length holds the sums that this and all
smaller lengths can reach with the pieces left (dynamic programming over subset sums), the highest bit is the
fullest feasible combination, and of the combinations with that sum the one with the most of the largest lengths
is taken and removed. While its pieces last the same combination stays the fullest, so it is taken as often as they
do: each round at least halves what is left of one length, and there are a few thousand rounds for any corpus.

Pieces get their places without meeting: a task numbers the pieces of each length as it tokenises, the counts
of (length, task) give each task's first number, and number and length tell the bin, its use of the length and so
the place in the sequence. The tables of bins and of their lengths are bounded by ``capacity`` too; they go to all
tasks. Nothing else is broadcast, and no task holds the pieces of a length.

Tokenising cuts texts at ASCII white space, and between an ASCII letter and a comma, stop, colon, semicolon,
question or exclamation mark, all of which the vocabulary's pattern never crosses, and encodes each distinct
word once with the tokenizers library, special tokens in the text included.

Defined cases: null text is an empty one, which has the closing id alone; a document of ``capacity`` tokens is one
piece; repeated rows and ids are separate documents, null ids are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import pieces as ranges
from .common import stored, string_buffers

CAPACITY = 4096
#: The id that closes each document.
END_ID = 1
#: Words, and their ids, that a worker remembers before it starts anew.
MEMO, MEMO_IDS = 400_000, 4_000_000
#: Words encoded as one text; letters from BEYOND on, and the one whose lower case is two characters, are not among them.
TOGETHER = 500
BEYOND, DOTTED = "\u0250", "\u0130"
#: Bits for the number of a piece among those of its length.
_NUMBER_BITS = 44
_SPACE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARKS = ",.;:!?"
_MARK[list(_MARKS.encode())] = True


class Encoder:
    """Ids of whole texts, from a memo of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core; the library would start a thread for each of the machine's
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = "".join(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = _MARK if not set(special) & set(_MARKS) else np.zeros(256, bool)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.last = None  # by id: whether a token ends a word
        if suffix := model.get("end_of_word_suffix"):
            self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
            self.last[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, words: list[str]) -> np.ndarray:
        """Where each word is in the memo."""
        if len(self.memo) > MEMO or len(self.flat) > MEMO_IDS:
            self.forget()
        at = list(map(self.memo.get, words))
        new = [w for w, i in zip(words, at, strict=True) if i is None]
        if new:
            new, flat, count = self.fresh(new)
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new)), strict=True))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.flat = np.concatenate((self.flat, flat))
            at = list(map(self.memo.__getitem__, words))
        return np.array(at, np.int64)

    def fresh(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words not met before, in another order, with their ids and how many each has.

        A word of Latin letters is one piece of the vocabulary's pattern, which ends with the one token that is marked
        as a word's last; so many are encoded as one text.
        """
        plain, odd = [], []
        for w in words:
            (plain if self.last is not None and w.isalpha() and max(w) < BEYOND and DOTTED not in w else odd).append(w)
        flat, _ = self.ids([" ".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)])
        ends = np.flatnonzero(self.last[flat]) if plain else np.zeros(0, np.int64)
        if len(ends) != len(plain):  # another pattern: one by one
            plain, odd, flat, ends = [], words, flat[:0], ends[:0]
        more, each = self.ids(odd)
        return plain + odd, np.concatenate((flat, more)), np.concatenate((np.diff(ends, prepend=-1), each))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(count.sum())), count

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the n+1 offsets of texts."""
        data, off = string_buffers(texts)
        inside = ~_SPACE[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edge = off[(off > 0) & (off < len(data))]
        begin[edge] |= inside[edge]
        begin[1:] |= self.marks[data[1:]] & _LETTER[data[:-1]]
        start = np.flatnonzero(begin)
        count = at = np.zeros(0, np.int64)
        if len(start):
            ends = np.append(np.cumsum(inside)[start] - 1, int(inside.sum()))
            found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
            at = self.learn(found.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(found.indices)]
            count = self.count[at]
        sums = np.append(0, np.cumsum(count))
        own = np.diff(sums[np.searchsorted(start, off)]) + 1
        out = np.full(int(sums[-1]) + len(own), end_id, np.uint32)
        to = np.cumsum(own)
        if sums[-1]:
            token = np.arange(sums[-1])
            out[token + np.repeat(np.arange(len(own)), own - 1)] = self.flat[token + np.repeat(self.first[at] - sums[:-1], count)] if len(at) else 0
        return out, np.append(0, to)


_encoders: dict[str, Encoder] = {}


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, own), and ``ids`` if asked for: the pieces of all documents.

    ``own`` numbers the pieces of one length in the task ``part``.
    """
    given = "piece int, start bigint, length bigint, ids_crc32 bigint, part int, own bigint" + (", ids array<int>" if ids else "")
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(given)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, j in ranges(string_buffers(b.column("text"))[1]):
                got, off = encoder.encode(b.column("text")[i:j], end_id)
                size = np.diff(off)
                many = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                first = off[:-1][row] + start
                raw = memoryview(got.astype("<u4").tobytes())
                crc = np.fromiter((zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(first.tolist(), length.tolist(), strict=True)), np.int64, len(row))
                order = np.argsort(length, kind="stable")
                sizes, at, n = np.unique(length[order], return_index=True, return_counts=True)
                own = np.empty(len(row), np.int64)
                own[order] = np.arange(len(row)) - np.repeat(at, n) + np.repeat(seen[sizes], n)
                seen[sizes] += n
                cols = [b.column("doc_id")[i:j].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), part, np.int32)), pa.array(own)]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(first, off[-1]), pa.int32()), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=kind.names)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins by minimum slack: ([(length, uses)], times), the lengths of a bin from the largest; all pieces are used up."""
    left = {n: c for n, c in sorted(counts.items()) if c > 0}
    mask = (1 << capacity + 1) - 1
    lengths, reach, out = list(left), [1], []
    usable = [min(c, capacity // n) for n, c in left.items()]
    while lengths:
        sums = reach[-1]
        for i in range(len(reach) - 1, len(lengths)):  # sums that lengths up to this reach: uses in steps of 1, 2, 4, ...
            n, rest, step = lengths[i], usable[i], 1
            while rest:
                step = min(step, rest)
                sums |= sums << step * n
                rest -= step
                step *= 2
            sums &= mask
            reach.append(sums)
        room, i, bin_ = sums.bit_length() - 1, len(lengths), []
        while room:
            i = bisect.bisect_right(lengths, room, 0, i) - 1
            n, below = lengths[i], reach[i]
            uses = min(usable[i], room // n)
            while uses and not below >> room - uses * n & 1:
                uses -= 1
            if uses:
                bin_.append((n, uses))
                room -= uses * n
        times = min(left[n] // k for n, k in bin_)
        out.append((bin_, times))
        lowest = len(lengths)
        for n, k in bin_:  # from the largest, so that places of the others stay
            left[n] -= times * k
            i, now = bisect.bisect_left(lengths, n), min(left[n], capacity // n)
            if now != usable[i]:
                lowest, usable[i] = i, now
                if not now:
                    del lengths[i], usable[i], left[n]
        del reach[lowest + 1 :]
    return out


def _places(plan: list[tuple[list[tuple[int, int]], int]]) -> tuple[np.ndarray, ...]:
    """By (length, first number): uses of the length in the bin, the bin's first sequence, the place of its first use."""
    rows, taken, sequence = [], {}, 0
    for lengths, times in plan:
        place = 0
        for n, uses in lengths:
            rows.append((n << _NUMBER_BITS | taken.get(n, 0), uses, sequence, place))
            taken[n] = taken.get(n, 0) + uses * times
            place += n * uses
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Stored pieces with their ``sequence_id`` and ``offset``; ``part`` and ``own`` go."""
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = bins({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)  # a row for each length
    key, uses, sequence, first = _places(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(begins, ["length", "part"]).withColumn("own", F.col("before") + F.col("own")).select(*[c for c in pieces.columns if c != "part"])
    kind = T.StructType([*[f for f in numbered.schema if f.name != "own"], *T.StructType.fromDDL("sequence_id bigint, offset bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, own = (np.asarray(b.column(c)) for c in ("length", "own"))
            at = np.searchsorted(key, length << _NUMBER_BITS | own, side="right") - 1
            nth = own - (key[at] & (1 << _NUMBER_BITS) - 1)
            cols = [b.column(c) for c in kind.names[:-2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[at] + nth // uses[at]), pa.array(first[at] + nth % uses[at] * length)], names=kind.names)

    return numbered.mapInArrow(run, kind)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document, packed."""
    return place(stored(cut(docs, vocabulary, capacity, end_id, ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; one holds ``capacity`` ids at most."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
