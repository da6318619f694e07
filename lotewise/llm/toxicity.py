"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of character n-grams. For every labelled text that names an
identity group, counterfactuals are made by swapping the group for others of its kind; training
penalises the squared change of the score's logit between a text and its counterfactuals, so
that neutral mentions of a group carry no weight of their own.

Training is bounded: at most ``sample`` labelled rows, by a hash of id and text. Executors
count their n-grams and keep at most ``FEATURES``; only these come to the driver, as integers. The
model is ``2**BITS`` weights, of which as many are not zero, and is broadcast. Scoring is one pass over whole texts, no shuffle.

Defined cases: null and empty texts get the bias's score; conflicting or repeated labels of one
id count each; without labelled rows of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import byte_grams, folded, pieces, stored, string_buffers
from .sampling import bounded

BITS = 20
SIZES = (5, 7)
#: Labelled rows to learn from, at most, and n-grams kept for their association with the label.
SAMPLE, FEATURES = 8000, 6000
#: Partitions that hold the sample, and ranges of n-gram ids.
PARTS = 16
#: Rows an n-gram must occur in to be kept; weights of the ridge and of the counterfactual penalty.
LEAST, RIDGE, FAIR = 3, 3e-4, 1.0
#: Score from which a text is rejected.
THRESHOLD = 0.7
#: Interchangeable terms of each kind of identity (fixed values).
IDENTITIES = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees"),
    ("deaf", "blind", "disabled"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
)
_KIND = {t: kind for kind in IDENTITIES for t in kind}
_TERM = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _KIND), key=len, reverse=True)) + r")\b", re.IGNORECASE)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One logit a text; an n-gram counts once, however often it occurs."""
        n = len(off) - 1
        out = np.full(n, self.bias)
        doc = np.repeat(np.arange(n), np.diff(off))
        keys = []
        for k in SIZES:
            f = feature_ids(data, k)
            at = np.flatnonzero((self.weights[f] != 0) & (doc[: len(f)] == doc[k - 1 :]) if len(f) else f)
            keys.append(doc[at] << BITS | f[at])
        keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return out + np.bincount(keys >> BITS, self.weights[keys & ((1 << BITS) - 1)], n)


def feature_ids(data: np.ndarray, k: int) -> np.ndarray:
    return (byte_grams(data, k) >> np.uint64(64 - BITS)).astype(np.int64)


def counterfactuals(text: str) -> list[str]:
    """Copies of a text with every identity term swapped, so that each meets every other term of its kind."""
    most = max((len(_KIND[t.lower()]) for t in _TERM.findall(text)), default=1)
    return [_TERM.sub(lambda m, i=i: (k := _KIND[m[0].lower()])[(k.index(m[0].lower()) + 1 + i % (len(k) - 1)) % len(k)], text) for i in range(most - 1)]


def _ids(texts: pa.Array) -> list[np.ndarray]:
    data, off = folded(texts)
    return [np.unique(np.concatenate([feature_ids(data[i:j], k) for k in SIZES])).astype(np.int32) for i, j in zip(off[:-1], off[1:], strict=True)]


def train(labelled: DataFrame, sample: int = SAMPLE, fair: float = FAIR) -> Model:
    """A model from (doc_id, text, toxic) rows; rows without a label are left out."""
    spark = labelled.sparkSession
    rows = labelled.where("toxic IS NOT NULL").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = rows.select("toxic").count()
    part = bounded(rows.withColumn("_all", F.lit(0)), ["doc_id", "text"], "_all", {0: sample}, {0: n}).drop("_all")
    part = stored(part.repartition(PARTS), "labelled")  # ``sample`` rows at most
    count = part.agg(F.count_if(F.col("toxic") > 0).alias("pos"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < count["pos"] < count["n"]:
        return Model(np.zeros(1 << BITS, np.float32), -50.0)
    keep = associated(part, count["pos"], count["n"] - count["pos"])
    shared = spark.sparkContext.broadcast(keep)  # FEATURES numbers at most

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            swaps = [(i, s) for i, t in enumerate(texts) for s in counterfactuals(t or "")]
            own = _ids(b.column("text"))
            other = _ids(pa.array([s for _, s in swaps], pa.string())) if swaps else []
            by: dict[int, list[bytes]] = {}
            for (i, _), ids in zip(swaps, other, strict=True):
                by.setdefault(i, []).append(_kept(ids, index))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([_kept(x, index) for x in own], pa.binary()), pa.array([by.get(i, []) for i in range(len(own))], pa.list_(pa.binary()))], names=["doc_id", "toxic", "ids", "swaps"])

    got = part.mapInArrow(features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, ids binary, swaps array<binary>").toPandas()  # at most ``sample`` rows of kept n-grams
    got = got.sort_values(["doc_id", "toxic"], kind="stable")
    y = got["toxic"].to_numpy(float)
    kind = _place_type(len(keep))
    return fit(keep, [np.frombuffer(x, kind) for x in got["ids"]], y, [[np.frombuffer(s, kind) for s in x] for x in got["swaps"]], fair)


def _place_type(n: int) -> type:
    """The smallest type for places among ``n`` n-grams."""
    return np.int16 if n < 1 << 15 else np.int32


def _index(keep: np.ndarray) -> np.ndarray:
    """The place of each n-gram id among those kept, -1 for the others."""
    index = np.full(1 << BITS, -1, _place_type(len(keep)))
    index[keep] = np.arange(len(keep))
    return index


def _kept(ids: np.ndarray, index: np.ndarray) -> bytes:
    at = index[ids]
    return at[at >= 0].tobytes()


def associated(part: DataFrame, pos: int, neg: int) -> np.ndarray:
    """The ids of the n-grams that go most with either label, ascending.

    A task counts rows by n-gram id in arrays of ``2**BITS``, sent in ranges of ids; a range's sums
    give the z of its n-grams, of which the largest are kept.
    """
    width = (1 << BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for b in batches:
            for ids, toxic in zip(_ids(b.column("text")), b.column("toxic").to_pylist(), strict=True):
                sums[0, ids] += 1
                if toxic > 0:
                    sums[1, ids] += 1
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *[pa.array([s[i * width : (i + 1) * width].tobytes() for i in range(PARTS)], pa.binary()) for s in sums]], names=["span", "total", "toxic"])

    def rank(key: tuple, rows: pa.Table) -> pa.Table:
        total, toxic = (sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in rows.column(c)) for c in ("total", "toxic"))
        p, q = toxic / pos, (total - toxic) / neg
        rate = np.maximum(total / (pos + neg), 1e-9)
        z = np.abs(p - q) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / pos + 1 / neg))
        at = np.flatnonzero((total >= LEAST) & (z > 2.0))
        return pa.table({"id": pa.array(at + key[0].as_py() * width, pa.int32()), "z": pa.array(z[at])})

    counted = part.mapInArrow(count, "span int, total binary, toxic binary").groupBy("span").applyInArrow(rank, "id int, z double")
    return np.sort(np.array([r["id"] for r in counted.orderBy(F.desc("z"), "id").limit(FEATURES).collect()], np.int64))


class _Rows:
    """A sparse 0/1 matrix by rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, m: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], m)


def fit(keep: np.ndarray, ids: list[np.ndarray], y: np.ndarray, swaps: list[list[np.ndarray]], fair: float, steps: int = 250) -> Model:
    """The model over the n-grams ``keep``; rows and their counterfactuals name them by place."""
    weights = np.zeros(1 << BITS, np.float32)
    y = (y > 0).astype(float)
    pos, neg = y.sum(), (1 - y).sum()
    x, m = _Rows(ids), len(keep)
    pairs = [(i, s) for i, many in enumerate(swaps) for s in many]
    a, b = _Rows([ids[i] for i, _ in pairs]), _Rows([s for _, s in pairs])
    # Adam on the mean loss; both kinds weigh alike
    w, bias = np.zeros(m), 0.0
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    each = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    for t in range(1, steps + 1):
        out = x.dot(w) + bias
        g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) * each
        grad = x.back(g, m) + RIDGE * w
        if pairs and fair:
            gap = a.dot(w) - b.dot(w)
            d = fair * 2 * gap / len(pairs)
            grad += a.back(d, m) - b.back(d, m)
        both = np.append(grad, g.sum())
        m1 = 0.9 * m1 + 0.1 * both
        m2 = 0.999 * m2 + 0.001 * both**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w -= step[:m]
        bias -= step[m]
    weights[keep] = w
    # the bias that best splits the training rows at the threshold, errors of each kind weighing alike
    out = x.dot(w)
    at = np.log(THRESHOLD / (1 - THRESHOLD))
    order = np.argsort(out, kind="stable")
    s, t = out[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(t))) / pos + (neg - np.concatenate(([0], np.cumsum(1 - t)))) / neg
    edges = np.concatenate(([s[0] - 2], (s[1:] + s[:-1]) / 2, [s[-1] + 2]))
    good = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return Model(weights, float(at - edges[good[len(good) // 2]]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "score")


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score as a column ``name``, which must be a new one."""
    if name in docs.columns:
        raise ValueError(f"there is a column {name} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            _, at = string_buffers(b.column("text"))
            z = [m.logits(*folded(b.column("text").slice(i, j - i))) for i, j in pieces(at)]
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -40, 40))) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below the threshold."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, name).where(F.col(name) < threshold).drop(name)
