"""Exact similarity self-join of documents on word shingles, by a grouped prefix join.

A document's set holds its distinct shingles of ``WORDS`` lower-cased words. Two documents link
when their sets' Jaccard similarity is at least ``PERCENT``/100.

1. Blocks of documents exchange shingle hashes once and learn each shingle's document frequency
   (only those that occur twice or more come back). Ordered by frequency, a set of n shingles has a
   prefix of n - ceil(0.8 n) + 1; a linked pair shares a shingle of both prefixes. Documents whose
   prefix has only shingles of their own are done; most are.
2. Equal sets collapse to a class, classes with identical prefix and size to a group. The prefix
   index is over groups: one posting for each prefix shingle that two groups share.
3. A posting list is not paired with itself. Each group meets the list's pivot (its least member
   in the same or the next size band); pairs pass the size and position filters and are verified
   by their sets; components are formed. Members of a group meet its head in the same way.
4. What a list still holds of different components is then paired in full: groups expand to their
   members, pairs pass the size, position and signature filters and are verified, so no link
   between components is lost, while lists of thousands of near copies cost about one pair each.

A signature is the parity of a set's hashes in ``BITS`` places: the places in which two signatures
differ are at most as many as the shingles that only one set has. The intersection of two sets
needs only their shingles of frequency two or more.

Defined cases: null, empty or blank text has an empty set and is linked with nothing; fewer words
than a shingle make the whole sequence the one shingle; equal rows are equal sets; a null id is
linked with nothing and its component is null; an empty table gives an empty result; long texts
are taken whole; ``one_of_each`` keeps other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, block_table, blocked, buckets, mix, n_blocks, n_buckets, pack_low, pieces, runs, stored, string_buffers, unpack_low
from .components import components

WORDS, PERCENT = 5, 80
_SEND = "bucket int, block int, keys binary, counts binary"
#: Bytes of a shingle sent for counting besides its bucket; a clash only makes one look more frequent.
_WIDTH = 5
BITS = 256


def shingle_sets(table: pa.Table) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    data, off = string_buffers(table.column("text"))
    for i, j in pieces(off):
        w = Words(data[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
        g = w.windows(WORDS)
        for a, b in zip(w.first[:-1], w.first[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(g[a : b - WORDS + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for x in w.hash[a:b]:
                    h = mix(np.array([h ^ x], np.uint64))[0] + np.uint64(1)
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def frequencies(blocks: DataFrame, count: int) -> DataFrame:
    """(block, bucket, keys, counts): shingles of each block that two documents or more have, with a level that grows with their number."""
    n = n_buckets(count)

    def pack_rows(key: str, own: np.ndarray, other: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        cut = np.append(runs(own), len(own))
        parts = list(zip(cut[:-1], cut[1:], strict=True))
        these, those = pa.array([int(own[i]) for i, _ in parts], pa.int32()), pa.array([other] * len(parts), pa.int32())
        return pa.table([these if key == "bucket" else those, those if key == "bucket" else these, pa.array([pack_low(keys[i:j], _WIDTH) for i, j in parts], pa.binary()), pa.array([counts[i:j].tobytes() for i, j in parts], pa.binary())], names=["bucket", "block", "keys", "counts"])

    def emit(key: tuple, rows: pa.Table) -> pa.Table:
        sets = shingle_sets(block_table(rows))
        keys, counts = np.unique(np.concatenate(sets) >> np.uint64(16), return_counts=True)
        keys = keys << np.uint64(16)
        return pack_rows("bucket", buckets(keys, n), key[0].as_py(), keys, np.minimum(counts, 255).astype(np.uint8))

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys = [unpack_low(x, _WIDTH, bucket, n) for x in rows.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("counts").to_pylist()])
        block = np.repeat(rows.column("block").to_pylist(), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        k, c, b = keys[order], counts[order], block[order]
        begin = runs(k)
        total = np.add.reduceat(c.astype(np.int64), begin) if len(k) else c
        each = np.repeat(total, np.diff(np.append(begin, len(k))))
        many = each > 1
        k, b = k[many], b[many]
        level = np.minimum(1 + (8 * np.log2(each[many])), 255).astype(np.uint8)
        by = np.argsort(b, kind="stable")
        return pack_rows("block", b[by], bucket, k[by], level[by])

    return blocks.groupBy("block").applyInArrow(emit, _SEND).groupBy("bucket").applyInArrow(reduce, _SEND)


def prefix_size(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


_SIGNED = "doc_id bigint, n_shingles bigint, node bigint, same bigint, prefix array<bigint>, at int, common binary, bits array<bigint>"


def signed(docs: DataFrame) -> DataFrame:
    """Each document's set size and, if its prefix can meet another's, its class, prefix and common shingles.

    ``node`` names the set, ``same`` the prefix and size; ``prefix`` holds its shared shingles, of
    which the first stands at place ``at`` of the set's order; ``common`` are the set's shingles
    that two documents or more have.
    """
    count = n_blocks(docs.select("doc_id", "text"))
    blocks = blocked(docs, ("doc_id", "text"), count)
    n = n_buckets(count)

    def short(x: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)

    def sign(rows: pa.Table, back: pa.Table) -> pa.Table:
        t = block_table(rows)
        parts = sorted(zip(*[back.column(c).to_pylist() for c in ("bucket", "keys", "counts")], strict=True))
        known = np.concatenate([unpack_low(k, _WIDTH, p, n) for p, k, _ in parts]) if parts else np.zeros(0, np.uint64)
        levels = np.concatenate([np.frombuffer(c, np.uint8) for _, _, c in parts]) if parts else np.zeros(0, np.uint8)
        ids = t.column("doc_id").to_pylist()
        out = []
        for doc, own in zip(ids, shingle_sets(t), strict=True):
            size, p = len(own), prefix_size(len(own))
            if doc is None or not size or not len(known):
                out.append((doc, size, None, None, None, None, None, None))
                continue
            short_key = own >> np.uint64(16) << np.uint64(16)
            at = np.minimum(np.searchsorted(known, short_key), len(known) - 1)
            level = np.where(known[at] == short_key, levels[at], 0)
            alone = int((level == 0).sum())
            if alone >= p:
                out.append((doc, size, None, None, None, None, None, None))
                continue
            common = own[level > 0]
            order = np.lexsort((common, level[level > 0]))
            prefix = common[order][: p - alone].view(np.int64)
            out.append((doc, size, short(own.tobytes()), short(prefix.tobytes() + size.to_bytes(8, "little")), prefix, alone, (common >> np.uint64(8) << np.uint64(8)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), np.packbits(np.bincount(own & np.uint64(BITS - 1), minlength=BITS) & 1).view(np.int64)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_shingles", "node", "same", "prefix", "at", "common", "bits"])

    return blocks.groupBy("block").cogroup(frequencies(blocks, count).groupBy("block")).applyInArrow(sign, _SIGNED)


def _fits(a: str, b: str) -> Column:
    """Whether two set sizes allow a link."""
    return F.expr(f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})")


def _need(a: str, b: str) -> str:
    """The least intersection that links sets of sizes a and b."""
    return f"(({PERCENT} * ({a} + {b}) + {99 + PERCENT}) div {100 + PERCENT})"


def _alike(a: str, b: str, bits: str, bits2: str) -> Column:
    """Whether two sets' sizes and signatures allow a link."""
    apart = " + ".join(f"bit_count({bits}[{i}] ^ {bits2}[{i}])" for i in range(BITS // 64))
    return _fits(a, b) & F.expr(f"{apart} <= {a} + {b} - 2 * {_need(a, b)}")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link."""
    left = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("common").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("common").alias("cb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for na, nb, ca, cb in zip(*[b.column(c) for c in ("na", "nb", "ca", "cb")], strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "V7") for v in (ca, cb))
                # both are sorted; as big-endian bytes they compare like numbers
                both = np.concatenate((_wide(x), _wide(y)))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= PERCENT * (na.as_py() + nb.as_py() - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").where(_fits("na", "nb")).select("a", "b", "na", "nb", "ca", "cb").mapInArrow(check, "a bigint, b bigint")


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, 1:] = x.view(np.uint8).reshape(-1, 7)
    return out.reshape(-1).view(">u8").astype(np.uint64)


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    s = stored(signed(docs), "signed")
    classes = stored(
        s.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n_shingles", "same", "prefix", "at", "common", "bits")]),
        "classes",
    )
    groups = classes.groupBy("same").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"), F.first("n_shingles").alias("n"), F.first("prefix").alias("prefix"), F.first("at").alias("at"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT))).cast("int")
    posts = groups.select("same", "head", "members", "n", "at", band.alias("band"), F.posexplode("prefix").alias("i", "token")).select("token", "same", "head", "members", "n", "band", (F.col("at") + F.col("i")).alias("place"))
    crowded = posts.groupBy("token").agg(F.sum("members").alias("c")).where("c > 1").select("token")
    posts = stored(posts.join(crowded, "token", "left_semi"), "posts")
    sets = classes.select("node", "n_shingles", "common")

    # each group and the pivots of its lists; each class and its group's head
    pivots = posts.groupBy("token", "band").agg(F.min("head").alias("pivot"))
    near = posts.select("token", "head", F.explode(F.expr("array(band, band - 1)")).alias("band")).join(pivots, ["token", "band"])
    met = near.where(F.col("head") != F.col("pivot")).groupBy("head", "pivot").agg(F.count(F.lit(1)).alias("shared"))
    sizes = classes.select("node", F.col("n_shingles").alias("n"), "bits")
    met = met.join(sizes.withColumnRenamed("node", "head"), "head").join(sizes.select(F.col("node").alias("pivot"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "pivot").where(_alike("n", "n2", "bits", "bits2"))
    best = met.groupBy(F.col("head").alias("a")).agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("b"))
    inside = classes.join(groups.select("same", "head"), "same").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    edges = stored(verified(best.unionByName(inside).distinct(), sets), "links")
    roots = stored(components(edges), "roots")

    # what is left: classes of one list in different components
    def rooted(r: DataFrame) -> DataFrame:
        return classes.select("node", "same", "prefix", "at", "bits").join(r, "node", "left").select("node", "same", F.coalesce("root", "node").alias("root"), "prefix", "at", "bits")

    member = stored(rooted(roots), "members")
    span = member.groupBy("same").agg(F.min("root").alias("l"), F.max("root").alias("h"))
    mixed = posts.select("token", "same").join(span, "same").groupBy("token").agg(F.min("l").alias("l"), F.max("h").alias("h")).where("l <> h").select("token")
    p = posts.join(mixed, "token", "left_semi").select("token", "same", "n", "place").join(member, "same").select("token", F.col("node").alias("a"), "n", "place", "root", "prefix", (F.col("place") - F.col("at")).cast("int").alias("i"), "bits")
    q = p.select("token", F.col("a").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("n", "place", "root", "prefix", "i", "bits")])
    # the overlap that can follow from this shingle on, against what a link needs
    room = F.expr(f"least(n - place, n2 - place2) >= {_need('n', 'n2')}")
    # a pair comes from the first shingle that its prefixes share
    lead = F.expr("NOT arrays_overlap(slice(prefix, 1, i), slice(prefix2, 1, i2))")
    pairs = p.join(q, (p["token"] == q["token"]) & (F.col("a") < F.col("b")) & (F.col("root") != F.col("root2")) & room & _alike("n", "n2", "bits", "bits2") & lead).select("a", "b")
    more = stored(verified(pairs, sets), "links")
    if not more.isEmpty():
        roots = stored(components(edges.unionByName(more)), "roots")
        member = rooted(roots)

    lows = member.join(classes.select("node", "low"), "node")
    least = lows.groupBy("root").agg(F.min("low").alias("component"))
    named = lows.join(least, "root").select("node", "component")
    return s.select("doc_id", "n_shingles", "node").join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least id of their component; ids are taken to be unique, rows without one stay."""
    keep = linked(docs).where("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_anti").select(docs.columns)
