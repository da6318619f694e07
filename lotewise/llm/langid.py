"""Language identification with bit-sliced Bloom filters over character n-grams.

Every language has a Bloom filter of the n-grams that a share of its training texts contain.
The filters are sliced: position p holds one bit per language, so ANDing the masks at an
n-gram's positions gives at once all languages that contain it. A text's language is the one
with most hits after the expected false positives of its filter are taken away.

Training takes labelled rows by a hash of id and text (whole texts): of each language its share of ``sample``
rows, its even share of them at least, or all that there are. That is twice ``sample``, and two rows a language, at most;
counts and masks are aggregated by Spark, and what is broadcast is the slice table of ``2**bits``
masks, whatever the corpus. Prediction is one pass over the texts without a shuffle.

Defined cases: null text, or one without a letter, is ``und`` with score 0; equal scores go to
the language that sorts first; without any training row every text is ``und``; repeated rows
give repeated rows; long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_grams, folded, pieces, stored, string_buffers
from .sampling import bounded

#: Bytes in an n-gram.
SIZES = (3, 5)
#: Labelled rows to learn from; twice as many with the even shares of rare languages.
SAMPLE = 6000
#: An n-gram belongs to a language if this share of its training texts has it.
SHARE = 0.02
#: Positions of the filters, as a power of two, and hashes for each n-gram.
BITS, HASHES = 19, 3


@dataclass
class Filters:
    """Slice table, learned languages in bit order, and each one's false-positive rate."""

    languages: list[str]
    slices: np.ndarray
    false_rate: np.ndarray


def positions(grams: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    return [((grams >> np.uint64(s)) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in range(0, 20 * HASHES, 20)]


def train(docs: DataFrame, sample: int = SAMPLE, share: float = SHARE, bits: int = BITS) -> Filters:
    """Filters from the text and lang of ``docs`` (already only those to learn from)."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return Filters([], np.zeros(1 << bits, np.uint64), np.zeros(0))
    if len(rows) > 64:
        raise ValueError(f"{len(rows)} languages; a mask has 64 bits")
    most = {x: min(n, max(math.ceil(sample * n / sum(rows.values())), math.ceil(sample / len(rows)))) for x, n in rows.items()}
    part = stored(bounded(known, ["doc_id", "text"], "lang", most, rows), "languages")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang").to_pylist()
            for name in sorted(set(langs)):
                rows = pa.array([i for i, x in enumerate(langs) if x == name])
                data, off = folded(b.column("text").take(rows))
                got = []
                for i, j in zip(off[:-1], off[1:], strict=True):
                    got.append(np.unique(np.concatenate([byte_grams(data[i:j], k) for k in SIZES])))
                keys, df = np.unique(np.concatenate(got), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(df.astype(np.int64))], names=["lang", "gram", "df"])

    sizes = {r["lang"]: r["n"] for r in part.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros(1 << bits, np.uint64), np.zeros(0))
    counted = part.mapInArrow(grams, "lang string, gram bigint, df bigint").groupBy("lang", "gram").agg(F.sum("df").alias("df"))
    rule = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, F.struct(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long").alias("bit"), F.lit(float(min(sizes[name], max(2.0, share * sizes[name])))).alias("least")))])
    kept = counted.select("gram", "df", rule[F.col("lang")].alias("r")).where("df >= r.least")
    mask = (1 << bits) - 1
    at = F.array(*[F.shiftrightunsigned("gram", s).bitwiseAND(F.lit(mask)) for s in range(0, 20 * HASHES, 20)])
    slices = np.zeros(1 << bits, np.uint64)
    masks = kept.select(F.explode(at).alias("p"), F.col("r.bit").alias("bit")).groupBy("p").agg(F.bit_or("bit").alias("m")).toArrow()  # at most 2**bits rows
    slices[np.asarray(masks.column("p"))] = np.asarray(masks.column("m")).view(np.uint64)
    fill = np.array([float(((slices >> np.uint64(i)) & np.uint64(1)).mean()) for i in range(len(languages))])
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    return Filters(languages, slices.astype(kind), fill**HASHES)


def hits(filters: Filters, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n-grams looked up, and corrected hits for every language."""
    n, langs = len(off) - 1, len(filters.languages)
    total, found = np.zeros(n), np.zeros((n, langs))
    doc = np.repeat(np.arange(n), np.diff(off))
    for k in SIZES:
        g = byte_grams(data, k)
        a, b, c = positions(g, int(len(filters.slices) - 1).bit_length())
        m = filters.slices[a] & filters.slices[b] & filters.slices[c]
        m[doc[: len(m)] != doc[k - 1 :]] = 0
        total += np.maximum(np.diff(off) - k + 1, 0)
        for i in range(langs):
            found[:, i] += np.bincount(doc[: len(m)], ((m >> m.dtype.type(i)) & m.dtype.type(1)).astype(np.float64), n)
    return total, np.maximum((found - total[:, None] * filters.false_rate) / (1 - np.minimum(filters.false_rate, 0.999)), 0)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the winner's share of the corrected hits."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 2**bits masks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, "und"], object)
        for b in batches:
            _, at = string_buffers(b.column("text"))
            for i, j in pieces(at):
                texts = b.column("text").slice(i, j - i)
                data, off = folded(texts)
                total, found = hits(f, data, off)
                best = found.argmax(1) if f.languages else np.zeros(j - i, int)
                top = found[np.arange(j - i), best] if f.languages else np.zeros(j - i)
                score = top / np.maximum(found.sum(1), 1e-9) if f.languages else top
                plain = np.concatenate(([0], np.cumsum((data > 96) & (data < 123))))[off]
                dull = np.zeros(j - i, bool)
                for k in np.flatnonzero(plain[1:] == plain[:-1]):  # no ASCII letter: look at the characters
                    dull[k] = not any(c.isalpha() for c in texts[int(k)].as_py() or "")
                dull |= not f.languages
                best = np.where(dull, len(f.languages), best)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(names[best], pa.string()), pa.array(np.where(dull, 0.0, np.minimum(score, 1.0)))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(parts: int, rest: int):
    """The rows of a fold: crc32 of the id's text, modulo ``parts``, is ``rest``; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == rest, F.lit(False))
