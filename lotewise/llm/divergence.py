"""Source divergence audit: how far the word use of each source of a language is from every other's.

Plain relational work: matches of the term pattern are counted by (lang, source, term); a language keeps the
terms that occur in ``least`` of its rows or more; every group (a source in a language) gets a row for every kept
term of the language, with a count of zero where it has none; that dense table joins itself on language and term;
sums of the terms' divergences give each two sources their values, and windows rank them.

Smoothed shares are whole numbers: p = 1 + floor(scale * (count + 1) / (N + V)), a divergence is
floor((p - q)^2 / q). Products of counts are decimals, so no count is too large; ``scale`` is at most 10^9, so
that squares stay in 64 bits. A sum that would leave them fails the query.

A row is a document. Tasks cut the terms in Arrow batches (the JVM's regular expressions took ten times as long)
and hold at most ``HELD`` sums, so documents are counted in the same pass as occurrences and only sums by
(lang, source, term) are shuffled. The dense table is dealt by language
and one of ``CELLS`` cells of terms, so no task holds a language; the self join is keyed by language and term, a
key's rows being the sources of the language. Tables of one row for each group are left to Spark's own checked
broadcasts. The 200 first terms of a group are cut in every task before they meet.

Defined cases: null text, lang and source count as ''; a group without terms is a group; a language without kept
terms gives its pairs a value of 0; ids are not read, so null and repeated ones are documents like others, and
equal rows are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, runs, stored, string_buffers

#: Rows of a language in which a term must occur to be kept.
LEAST = 3
SCALE = 1_000_000_000
#: Terms reported for a group.
TOP = 200
#: Parts that a language's terms are dealt into when they meet its groups.
CELLS = 256
#: Sums that a task holds before it gives them on.
HELD = 2_000_000
ROWS_OUT = 50_000

#: Terms are the longest runs of ASCII letters, in lower case, and bytes of characters beyond ASCII; all else is a gap.
_GAP = 32
_TERM_BYTE = np.full(256, _GAP, np.uint8)
_TERM_BYTE[97:123] = _TERM_BYTE[65:91] = np.arange(97, 123)
_TERM_BYTE[128:] = np.arange(128, 256)


def _known(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


class _Counts:
    """What a task has counted so far: a number for each group and term, and sums by both."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: pa.Array = pa.array([], pa.large_string())
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, lang: list[str], source: list[str], text: pa.Array) -> None:
        data, off = string_buffers(text)
        data = _TERM_BYTE[data]
        inside = data != _GAP
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edge = off[(off > 0) & (off < len(data))]
        begin[edge] |= inside[edge]  # a text that begins where another ends
        start = np.flatnonzero(begin)
        if not len(start):
            return
        width = np.diff(np.append(np.cumsum(inside)[start] - 1, int(inside.sum())))
        found = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(0, np.cumsum(width)).astype(np.int64)), pa.py_buffer(data[inside])).dictionary_encode()
        at = pc.index_in(found.dictionary, value_set=self.terms)
        fresh = np.asarray(at.is_null())
        code = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        code[fresh] = len(self.terms) + np.arange(int(fresh.sum()))
        self.terms = pa.concat_arrays([self.terms, found.dictionary.filter(pa.array(fresh))])
        row = np.searchsorted(off, start, side="right") - 1
        held, n = np.unique(row << 32 | code[np.asarray(found.indices)], return_counts=True)  # a row's terms, once each
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(lang, source, strict=True)], np.int64)
        self.parts.append(_summed(group[held >> 32] << 32 | held & 0xFFFFFFFF, n.astype(np.int64), np.ones(len(n), np.int64)))

    def size(self) -> int:
        if len(self.parts) > 1 and sum(len(p[0]) for p in self.parts) > HELD:
            self.parts = [_summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
        return sum(len(p[0]) for p in self.parts)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        key, n, docs = _summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        lang, source = (pa.array(x, pa.string()) for x in zip(*self.groups, strict=True))
        for i in range(0, len(key), ROWS_OUT):
            k = key[i : i + ROWS_OUT]
            g = pa.array(k >> 32)
            term = self.terms.take(pa.array(k & 0xFFFFFFFF)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(g), source.take(g), term, pa.array(n[i : i + ROWS_OUT]), pa.array(docs[i : i + ROWS_OUT])], names=["lang", "source", "term", "n", "docs"])


def _summed(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by key, in the order of keys."""
    order = np.argsort(key, kind="stable")
    key, cut = key[order], runs(key[order])
    return key[cut], np.add.reduceat(n[order], cut), np.add.reduceat(docs[order], cut)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for b in batches:
        lang, source, text = (b.column(c) for c in ("lang", "source", "text"))
        for i, j in pieces(string_buffers(text)[1]):
            counts.add(lang[i:j].to_pylist(), source[i:j].to_pylist(), text[i:j])
            if counts.size() > HELD:
                yield from counts.rows()
                counts = _Counts()
    yield from counts.rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term.

    Tasks sum before the one shuffle, which is by language and term, as all that follows is grouped by them.
    """
    counted = _known(docs).mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, scale: int = SCALE) -> Column:
    """The smoothed share of a count in a group with ``total`` occurrences, as a whole number.

    Products beyond 64 bits are taken as decimals; the value is the same.
    """
    wide = "cast({} as decimal(18, 0))"
    far = f"(cast({scale} as decimal(10, 0)) * ({wide.format(count)} + 1)) div ({wide.format(total)} + {wide.format('v')})"
    return F.expr(f"1 + if({count} < {(1 << 62) // scale}, ({scale} * ({count} + 1)) div ({total} + v), {far})")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def kept_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, term, n, total, once) of kept terms; ``total`` is the language's, ``once`` marks one row a term."""
    term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).select("lang", "source", "term", "n", F.sum("docs").over(term).alias("docs"), F.sum("n").over(term).alias("total"), (F.row_number().over(term.orderBy("source")) == 1).alias("once"))
    return counted.where(F.col("docs") >= least).drop("docs")


def group_facts(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, n_group, n_lang, v, g): a row for every group that occurs; ``g`` is a number of its own."""
    groups = _known(docs).select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("once").alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_group", "n_lang", "v"]).withColumn("g", F.monotonically_increasing_id())


def dense(kept: DataFrame, facts: DataFrame, cells: int = CELLS, scale: int = SCALE) -> DataFrame:
    """(lang, term, g, p): every group with every kept term of its language, counts of zero included."""
    cell = F.pmod(F.xxhash64("term"), F.lit(cells)).cast("int")
    vocabulary = kept.where("once").select("lang", "term", cell.alias("cell"))
    groups = facts.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    every = vocabulary.join(groups, ["lang", "cell"]).select("lang", "source", "term", "g", "n_group", "v")
    counted = every.join(kept.select("lang", "source", "term", "n"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    return counted.select("lang", "term", "g", share("n", "n_group", scale).alias("p"))


def pair_values(every: DataFrame, facts: DataFrame) -> DataFrame:
    """(lang, source, item, value): each ordered pair of sources of a language.

    The self join takes each two groups once and sums both directions.
    """
    a, b = every.alias("a"), every.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.g") < F.col("b.g")))
    sums = met.groupBy(F.col("a.g").alias("low"), F.col("b.g").alias("high")).agg(F.sum(divergence("a.p", "b.p")).alias("up"), F.sum(divergence("b.p", "a.p")).alias("down"))
    both = sums.select(F.inline(F.array(F.struct(F.col("low").alias("g"), F.col("high").alias("h"), F.col("up").alias("value")), F.struct(F.col("high").alias("g"), F.col("low").alias("h"), F.col("down").alias("value")))))
    own = facts.select("lang", "source", "g")
    named = both.join(own, "g").join(own.select(F.col("source").alias("item"), F.col("g").alias("h")), "h").select("lang", "source", "item", "value")
    silent = facts.where("v = 0").select("lang", "source")  # languages without kept terms are not in the dense table
    others = silent.join(silent.withColumnRenamed("source", "item"), "lang").where("source != item")
    return named.unionByName(others.withColumn("value", F.lit(0).cast("long")))


def term_values(kept: DataFrame, facts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, source, item, value): terms that a group uses more than its language does."""
    shares = kept.join(facts, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "n_group", scale).alias("p"), share("total", "n_lang", scale).alias("q"))
    return shares.where("p > q").select("lang", "source", "item", divergence("p", "q").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources, all ranks, and each group's ``top`` terms."""
    kept = stored(kept_counts(docs, least), "kept-terms")
    facts = stored(group_facts(docs, kept), "groups")
    every = stored(dense(kept, facts, scale=scale), "dense-terms")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(every, facts).withColumn("rank", F.row_number().over(order))
    terms = term_values(kept, facts, scale).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).unionByName(terms.withColumn("part", F.lit("term")).select(columns))
