"""Packing: ids against the tokenizers library, places against the contract, bins against exhaustive search."""

import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotewise.llm import common, packing

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = "aZ é̸́ß日本語   \x85\x0b\x0c\x1c\t\n\r'st'Re1٣½ <|endoftext|> <|startoftext|>🙂İΣς.,!_\x00.a,b;c:"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


ENCODER = packing.Encoder(FILE)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(sorted(set(ODD))), max_size=40), st.text(max_size=30)), max_size=6))
def test_ids(library, texts):
    got, off = ENCODER.encode(pa.array(texts, pa.string()), 1)
    assert [got[i:j].tolist() for i, j in zip(off, off[1:], strict=False)] == [library(t) for t in texts]


def brute_fullest(counts, capacity):
    return max(s for uses in product(*[range(c + 1) for c in counts.values()]) if (s := sum(n * k for n, k in zip(counts, uses, strict=True))) <= capacity)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 4), min_size=1, max_size=5))
def test_each_bin_is_the_fullest(counts):
    left = dict(counts)
    for lengths, times in packing.bins(counts, 12):
        for _ in range(times):
            assert sum(n * k for n, k in lengths) == brute_fullest(left, 12)
            for n, k in lengths:
                left[n] -= k
                assert left[n] >= 0
    assert not any(left.values())


def test_bins_at_scale():
    rng = np.random.default_rng(5)
    counts = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 300_000).astype(int) + 1).tolist())
    plan = packing.bins(counts)
    assert len(plan) < 12_000 and sum(t for _, t in plan) == -(-sum(n * c for n, c in counts.items()) // 4096)
    assert len(packing.bins({n: c * 10**6 for n, c in counts.items()})) < 12_000


def check(rows, texts, library, capacity):
    """Whether the pieces are those of the texts and lie in their sequences without gaps."""
    want = Counter()
    for doc, t in texts:
        ids = library(t)
        for p, i in enumerate(range(0, len(ids), capacity)):
            raw = np.array(ids[i : i + capacity], "<u4").tobytes()
            want[doc, p, i, len(raw) // 4, zlib.crc32(raw)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack(spark, library):
    common.prepare(spark)
    rng = np.random.default_rng(1)
    texts = [(None, None), (1, ""), (2, " \n"), (2, " \n"), (None, "one two"), (7, "w" * 900), (8, ODD)]
    texts += [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(0, 90)))) for i in range(10, 150)]
    texts += [(200, "the cat " * 1000)] + [(300 + i, "same words in each copy") for i in range(60)]
    schema = "doc_id bigint, text string, piece int, part int, own bigint, length bigint, sequence_id string, offset string, ids string"
    docs = spark.createDataFrame([(d, t, 1, 2, 3, 4, "s", "o", "i") for d, t in texts], schema).repartition(5)
    packed = packing.pack(docs, FILE, capacity=100)
    rows = packed.collect()
    used = check(rows, texts, library, 100)
    total = sum(len(library(t)) for _, t in texts)
    assert used <= -(-total // 100) + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert sum(map(len, whole.values())) == total
    for r in rows:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert packing.pack(docs.limit(0), FILE).count() == 0
    assert packing.pack(docs, FILE, ids=False).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_text_ids(spark, library):
    docs = spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string")
    assert sorted((r.doc_id or "") for r in packing.pack(docs, FILE, ids=False).collect()) == ["", "a"]


def test_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    encoder = packing.Encoder(FILE)
    for text in ("a b c d", "e a f", "a b zzz"):
        assert encoder.encode(pa.array([text]), 1)[0].tolist() == library(text)
