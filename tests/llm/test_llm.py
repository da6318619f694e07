"""Operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotewise.llm import ann, bpe, common, decontaminate, jaccard_join, katz, langid, sharding, substring_dedup, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, block int, node bigint"
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, vocab=3000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocab, n))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    base = words(rng, 120)
    texts = [None, "", "  \t\n", "one", "One two", "one TWO", base, base, base.upper(), base.replace(" ", "\n "), "<|endoftext|>x  y z é　日本 🙂 " + "a" * 500]
    for i in range(12):  # near copies, some over and some under the line
        w = base.split()
        for j in rng.integers(0, 120, 1 + i // 3):
            w[j] = f"new{i}"
        texts.append(" ".join(w))
    shared = words(rng, 40)
    texts += [words(rng, 60) + " " + shared + " " + words(rng, 30) for _ in range(6)]
    texts += [words(rng, 4000) + " " + base, shared + " " + shared]
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    common.prepare(spark)
    rows = [(i, t, ["en", "fr", None][i % 3], "s", 7, 0.5, 1, 2) for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def tokens(t):
    return (t or "").encode().split()


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_jaccard(docs, corpus, spark):
    sets = []
    for t in corpus:
        w = tokens(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(corpus)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert jaccard_join.linked(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, corpus[6]), (None, None), (5, corpus[6]), (5, corpus[6]), (3, corpus[6])], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.linked(odd).collect()) == [(-1, -1), (-1, -1), (3, 3), (5, 3), (5, 3)]


def removed(texts, n=20):
    seen, out = set(), []
    for t in texts:
        w = tokens(t)
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone[i : i + n] = [True] * n
            seen.add(k)
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def test_substring(docs, corpus, spark):
    want = removed(corpus)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(docs).collect()}
    assert got == {i: (a, b, hashlib.sha256(k).hexdigest()) for i, (a, b, k) in enumerate(want)}
    out = substring_dedup.dedup(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        assert r.text == (corpus[r.doc_id] if not want[r.doc_id][1] else want[r.doc_id][2].decode())
    assert substring_dedup.digests(docs.limit(0)).count() == 0
    ref = substring_dedup.remove_reference(docs.select("doc_id", "text"), [corpus[6]])
    assert {r.doc_id: r.text for r in ref.collect()}[7] == ""
    given = [corpus[6], None, corpus[-2]]
    whole = {(r.doc_id, r.text) for r in substring_dedup.remove_reference(docs.select("doc_id", "text"), given).collect()}
    cut = {(r.doc_id, r.text) for r in substring_dedup.remove_reference(docs.select("doc_id", "text"), given, most=9000).collect()}
    known = {tuple(w[i : i + 20]) for t in given for w in [tokens(t)] for i in range(len(w) - 19)}
    for i, t in enumerate(corpus):
        w = tokens(t)
        gone = [any(tuple(w[j : j + 20]) in known for j in range(max(0, k - 19), k + 1)) for k in range(len(w))]
        want = t if not any(gone) else b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
        assert (i, want) in whole and (i, want) in cut
    assert len(list(substring_dedup.reference_shards(given, 20, 9000))) > 1


def test_automaton():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 60).tolist(), rng.integers(0, 3, 40).tolist()
    has = {tuple(a[i:j]) for i in range(60) for j in range(i + 1, 61)}
    want = [max((n for n in range(1, e + 1) if tuple(b[e - n : e]) in has), default=0) for e in range(1, 41)]
    assert substring_dedup.SuffixAutomaton(a).statistics(b) == want


def test_bpe(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = {r.doc_id: r for r in bpe.round_trip(docs, BPE).collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, BPE).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, BPE), BPE).collect()}
    for i, x in enumerate(corpus):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert ids[i] == want and back[i] == t.decode(want, skip_special_tokens=False)
        assert rows[i].n_tokens == len(want) and rows[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(back[i].encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BPE).count() == 0


def test_sharding(docs, corpus, spark):
    twice = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame([(None, "x", None, None, None, None, None, None)], DOCS))
    rows = sharding.assign(twice, 3, 64).collect()
    assert len(rows) == len(corpus) + 4
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        if r.doc_id is not None:
            raw = (corpus[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.assign(docs.limit(0)).count() == 0
    weights = {s: 10 + s % 7 for s in range(64)}
    old = sharding.pack(weights, 4, 64)
    new = sharding.rebalance(old, weights, 5)
    load = Counter()
    for s, shard in new.items():
        load[shard] += weights[s]
    assert set(new.values()) == set(range(5)) and max(load.values()) - min(load.values()) <= 20
    assert all(new[s] in (old[s], 4) for s in old)
    assert set(sharding.rebalance(new, weights, 3).values()) == {0, 1, 2}


def test_sharding_bytes_are_near_equal_and_maps_versioned(spark, tmp_path):
    """Shard bytes differ by a slot at most, hot ids and texts spread, and the next version of a map moves no more slots than it must."""
    rng = np.random.default_rng(7)
    rows = [(i, words(rng, int(rng.integers(1, 60)))) for i in range(1500)] + [(7, f"hot id {i}") for i in range(600)] + [(None, f"no id {i}") for i in range(600)] + [(10_000 + i, "the same text") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = f"file://{tmp_path}/map"
    one = sharding.assign(d, 4, 256, path).collect()
    by_slot, by_shard = Counter(), Counter()
    for r in one:
        by_slot[r.virtual_slot] += r.size
        by_shard[r.shard] += r.size
    assert len(one) == len(rows) and max(by_shard.values()) - min(by_shard.values()) <= max(by_slot.values()) < sum(by_slot.values()) / 50
    assert sharding.latest(spark, path) == 1 and sharding.latest(spark, f"{path}-none") == 0
    sharding.rebalance_table(d, path, 5)
    two = sharding.assign(d, path=path).collect()
    was, now = {r.virtual_slot: r.shard for r in one}, {r.virtual_slot: r.shard for r in two}
    assert {r.map_version for r in two} == {2} and all(now[s] in (was[s], 4) for s in was) and set(now.values()) == set(range(5))
    load = Counter()
    for r in two:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) <= max(by_slot.values())
    more = d.unionByName(spark.createDataFrame([(50_000 + i, "new " * 9) for i in range(300)], "doc_id bigint, text string"))
    three = sharding.assign(more, path=path).collect()
    assert {r.doc_id: r.shard for r in three if r.doc_id and r.doc_id != 7 and r.doc_id < 50_000} == {r.doc_id: r.shard for r in two if r.doc_id and r.doc_id != 7}
    for rs in (two, three):
        for s in range(5):
            assert sorted(r.slot for r in rs if r.shard == s) == list(range(sum(r.shard == s for r in rs)))


def test_warc(spark):
    big = "é" * 60
    data = [(3, "http://a\r\nX: y", big, 1), (1, None, big, 1), (2, "u", "x" * 99, 1), (4, "u", "x" * 99, 1), (5, "u", None, 1), (6, "u", "WARC/1.1\r\n\r\n" * 20, 1), (1, None, big, 1), (None, "u", big, 1)]
    got = warc.round_trip(spark.createDataFrame(data, "page_id bigint, url string, html string, digest int")).collect()
    assert len(got) == len(data)
    by = Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert by == Counter({(3, "revisit", 1, 120): 1, (1, "response", None, 120): 1, (1, "revisit", 1, 120): 1, (None, "revisit", 1, 120): 1, (2, "response", None, 99): 1, (4, "response", None, 99): 1, (5, "response", None, 0): 1, (6, "response", None, 240): 1})
    assert {r.payload_digest for r in got if r.page_id == 3} == {hashlib.sha256(big.encode()).hexdigest()}
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[50:120] = x[50]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [(400, None, 1), (420, [0.0] * 12, 1), (440, [float("nan")] + [0.0] * 11, 1), (460, [None] + [1.0] * 11, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, shard int")
    got = ann.search(df, F.col("vec_id") % 20 == 0, shard_rows=150).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        want = [v for v in np.lexsort((np.arange(400), -s)) if v != q][:20]
        rows = sorted(by[q])
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(s[v] - c) < 1e-12 for _, v, c in rows)
        hit += len(set(want) & {v for _, v, _ in rows})
    assert set(by) == set(range(0, 400, 20)) and hit / 400 >= 0.9
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert len(ann.search(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()) == 3


@pytest.mark.parametrize(("dims", "spread"), [(64, 0.0), (64, 0.7), (128, 0.0)])
def test_ann_recall_of_a_full_shard(dims, spread):
    """A shard of the default size against brute force: similar norms, and norms that differ by their logarithm."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(ann.SHARD_ROWS, dims))
    if spread:
        x *= np.exp(spread * rng.normal(size=(len(x), 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    g = ann.build(np.arange(len(x)), x, float(np.linalg.norm(x.astype(float), axis=1).max()))
    s = x[:100].astype(float) @ x.T.astype(float)
    s[np.arange(100), np.arange(100)] = -np.inf
    found, _ = ann.search_graph(g, x[:100], ann.BEAM)
    hit = 0
    for i in range(100):
        ids = [int(g["ids"][g["begin"][c]]) for c in found[i] if c >= 0]
        assert len(set(ids)) == len(ids)
        best = sorted((v for v in ids if v != i), key=lambda v: -s[i, v])[:20]
        hit += len(set(best) & set(np.argsort(-s[i])[:20].tolist()))
    assert hit / 2000 >= 0.9


def test_ann_odd_rows(spark):
    """Null and repeated ids, two lengths, equal vectors: ties go to the smaller id."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (5, [0.0, 1.0]), (None, [9.0, 9.0]), (7, [9.0, 9.0, 9.0]), (20, [9.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert sorted(set(got)) == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 5, 0.0)]


def brute_katz(toks, train, order):
    """A function (document, place) -> probability, and the word counts: every order straight from the definition."""
    counts = [Counter() for _ in range(order)]
    padded = {i: ["<s>"] * (order - 1) + t for i, t in enumerate(toks)}
    past = Counter()
    for i in train:
        for at in range(order - 1, len(padded[i])):
            for k in range(order):
                g = tuple(padded[i][at - k : at + 1])
                counts[k][g] += 1
                past[g[:-1]] += k > 0
    n = sum(counts[0].values())
    d = [katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]) for c in counts]
    cut = lambda k, x: x * (d[k][x] if x <= katz.K else 1)
    unknown = 1 - sum(cut(0, x) for x in counts[0].values()) / n
    sums = {}

    def p(g):
        k = len(g) - 1
        if not k:
            return cut(0, counts[0][g]) / n if counts[0][g] else unknown
        if not past[g[:-1]]:
            return p(g[1:])
        if g[:-1] not in sums:
            seen = followers.get(g[:-1], ())
            sums[g[:-1]] = sum(cut(k, counts[k][x]) for x in seen), sum(p(x[1:]) for x in seen)
        a, b = sums[g[:-1]]
        left, f = 1 - a / past[g[:-1]], 1.0
        if left < 1e-12:
            left, f = 1 / (past[g[:-1]] + 1), past[g[:-1]] / (past[g[:-1]] + 1)
        return f * cut(k, counts[k][g]) / past[g[:-1]] if counts[k][g] else left / (1 - b) * p(g[1:])

    followers = {}
    for c in counts[1:]:
        for g in c:
            followers.setdefault(g[:-1], []).append(g)
    return (lambda i, at: p(tuple(padded[i][at : at + order]))), p, counts[0]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(docs, corpus, order):
    got = {r.doc_id: r for r in katz.score(docs, order=order).collect()}
    toks = [[w.decode() for w in tokens(lower(t))] + ["</s>"] for t in corpus]
    train = [i for i in range(len(corpus)) if zlib.crc32(str(i).encode()) % 10]
    at, p, c = brute_katz(toks, train, order)
    n, v = sum(c.values()), len(c)
    for h in [x[0] for x in list(c)[:6]]:
        assert abs(sum(p((h,) * (order - 1) + w) for w in c) + p((h,) * (order - 1) + ("<unknown>",)) - 1) < 1e-9
    for i, t in enumerate(toks):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(t), sum(c[w,] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w,] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6
        assert abs(r.score - sum(math.log10(at(i, j)) for j in range(len(t)))) < 1e-6
    assert katz.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_katz_keeps_every_pair(spark, order):
    """N-grams of rare words against an unpruned brute force; most words are in one block, some in all."""
    rng = np.random.default_rng(8)
    texts = [f"only{i} met only{i}b near {words(rng, 30, 40)} twice seen rare{i // 2} pair{i // 2}" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in katz.score(rows, order=order).collect()}
    toks = [[*t.split(), "</s>"] for t in texts]
    at, _, c = brute_katz(toks, [i for i in range(60) if zlib.crc32(str(i).encode()) % 10], order)
    assert max(c[w,] for i in range(60) for w in (f"only{i}", f"rare{i}")) < 5
    for i, t in enumerate(toks):
        assert abs(got[i].score - sum(math.log10(at(i, j)) for j in range(len(t)))) < 1e-6


def test_katz_without_training(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b", "a b"])], "doc_id bigint, text string")
    got = katz.score(rows, parts=1, rest=0).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in got] == [(True, 0, 0, 0.0)] * 4
    odd = katz.score(spark.createDataFrame([(None, "a b"), (None, "a b"), (None, "c"), (5, "a b")], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_tokens, r.train_tokens) for r in odd) == [(-1, 2, 11), (-1, 3, 11), (-1, 3, 11), (5, 3, 11)]


def test_exchange_grows_in_proportion():
    """Rows that blocks send, and keys a reducer holds, at sizes that local runs cannot reach."""
    rows = [b * min(common.n_buckets(b), 700_000) for b in (64, 256, 1024, 4096)]
    assert [y / x for x, y in zip(rows[:-1], rows[1:], strict=True)] == [4, 4, 4]
    for b in (64, 4096, 1 << 16, 1 << 20):
        assert b / common.n_buckets(b) <= common.BUCKET_BLOCKS


def test_place_spreads_hot_ids():
    """An id, or no id, that fills several blocks goes to all of them by text; equal rows stay together."""
    ids = np.array([1] * 10 + [7] * 60 + [9] * 10 + [0] * 20)
    none = np.array([False] * 80 + [True] * 20)
    texts = pa.array([f"t{i % 50}" for i in range(100)])
    at = common.place(ids, none, texts, np.array([7, 7, 7, 7]), 2)
    assert set(at[:10]) == {0} and set(at[10:70]) == {1, 2, 3, 4} and set(at[70:80]) == {4} and set(at[80:]) == {5, 6}
    assert all(len({int(a) for a, t in zip(at[10:70], texts[10:70].to_pylist(), strict=True) if t == x}) == 1 for x in set(texts[10:70].to_pylist()))


def test_decontaminate(docs, corpus, spark):
    rng = np.random.default_rng(9)
    item = [f"rare{i}" for i in range(30)]
    edited = [w if i % 6 else "other" for i, w in enumerate(item)]
    rows = [(100, words(rng, 50) + " " + " ".join(item) + " " + words(rng, 50)), (101, " ".join(edited).upper() + "."), (102, words(rng, 300)), (103, " ".join(item[:6]) + words(rng, 80)), (104, None)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    bench = spark.createDataFrame([(1, " ".join(item), 5), (2, None, 5), (3, "too short", 5)], "item_id bigint, text string, doc_id int")
    got = {r.doc_id: r for r in decontaminate.find(d, bench).collect()}
    assert set(got) == {100, 101} and (got[100].score, got[100].first_word, got[100].end_word) == (1.0, 50, 80)
    kept = decontaminate.clean(d.withColumn("item_id", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "item_id"] and kept.count() == d.count() - 2
    assert decontaminate.find(d, bench.limit(0)).count() == 0 and decontaminate.find(d.limit(0), bench).count() == 0
    odd = spark.createDataFrame([(None, " ".join(item)), (7, " ".join(item)), (7, " ".join(item))], "doc_id bigint, text string")
    assert sorted((r.doc_id or -1, r.item_id) for r in decontaminate.find(odd, bench.unionByName(bench)).collect()) == [(-1, 1), (7, 1), (7, 1)]
    assert decontaminate.align(np.array([1, 2, 3, 9, 4]), np.array([2, 3, 4])) == (pytest.approx((6 - 1) / 6), 1, 5)


def test_decontaminate_common_words(spark):
    """An item whose words many documents have, but for one rare trigram that an edited copy lacks."""
    rng = np.random.default_rng(11)
    item = [f"w{x}" for x in rng.integers(0, 12, 24)]
    item[2:5] = ["qua", "quo", "qui"]
    edited = [*item[:3], "other", *item[4:13], "more", *item[14:]]
    rows = [(i, words(rng, 200, 12)) for i in range(80)] + [(100, words(rng, 90, 4000) + " " + " ".join(edited) + " " + words(rng, 90, 4000)), (101, " ".join(item))]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    got = {r.doc_id: r.score for r in decontaminate.find(d, bench).collect()}
    want = {i: decontaminate.align(*(np.array([hash(w) for w in x]) for x in (t.split(), item)))[0] for i, t in rows}
    assert want[100] >= 0.5 and got == {i: pytest.approx(s) for i, s in want.items() if s >= 0.5}


def test_langid(spark):
    rng = np.random.default_rng(2)
    alphabet = {"xx": "abcdefg", "yy": "cdefghijk"}
    text = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(80))
    rows = [(i, text(alphabet[n]), n) for i in range(60) for n in ("xx", "yy")] + [(900, None, "xx"), (901, "123 !!", "yy"), (902, "", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = langid.train(d)
    got = langid.predict(d, f).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id >= 900} == {"und"}
    truth = Counter((r.doc_id, n) for r, n in ((r, r.lang_pred) for r in got))
    assert sum(truth[(i, n)] for i, _, n in rows[:120]) >= 118
    assert {r.lang_pred for r in langid.predict(d, langid.train(d.limit(0))).collect()} == {"und"}


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        bad = i % 3 == 0
        w = words(rng, 30).split() + (["scum", "vermin"] if bad else []) + (["muslims"] if bad and i % 2 else [])
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(bad)))
    d = spark.createDataFrame([*rows, (900, None, 0), (901, "", None)], "doc_id bigint, text string, toxic int")
    fair, plain = toxicity.train(d), toxicity.train(d, fair=0.0)
    s = {r.doc_id: r.score for r in toxicity.score(d, fair).collect()}
    assert len(s) == 302 and all(0 <= x <= 1 for x in s.values())
    assert sum((s[i] >= toxicity.THRESHOLD) == bool(t) for i, _, t in rows) >= 295
    two = spark.createDataFrame([(1, "muslims met here"), (2, "christians met here")], "doc_id bigint, text string")
    gap = lambda m: abs(np.subtract(*[math.log(r.score / (1 - r.score)) for r in toxicity.score(two, m).collect()]))
    assert gap(fair) < gap(plain)
    assert all(r.score < 1e-9 for r in toxicity.score(two, toxicity.train(d.limit(0))).collect())


def test_counterfactuals():
    kind = ("muslims", "christians", "jews", "hindus", "buddhists", "atheists")
    assert sorted(toxicity.counterfactuals("Muslims met")) == sorted(f"{k} met" for k in kind[1:])
    assert toxicity.counterfactuals("men met") == ["women met"] and toxicity.counterfactuals("all met") == []
    both = toxicity.counterfactuals("jews and women")
    assert len(set(both)) == 5 and all(x.endswith(" and men") and not x.startswith("jews") for x in both)


def test_langid_rare_language(spark):
    rng = np.random.default_rng(6)
    text = lambda a: " ".join("".join(rng.choice(list(a), 5)) for _ in range(60))
    rows = [(i, text("abcdefg"), "xx") for i in range(400)] + [(1000 + i, text("qrstuvw"), "zz") for i in range(2)] + [(2000, text("hijkl"), "ww")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, langid.train(d, sample=20)).collect()}
    assert (got[0], got[1000], got[1001], got[2000]) == ("xx", "zz", "zz", "ww")


def test_warc_payloads(spark, tmp_path):
    data = [(1, "http://a", "é" * 60), (2, "http://b", "<p>x"), (3, "http://c", "é" * 60), (4, None, None)]
    warc.write(spark.createDataFrame(data, "page_id bigint, url string, html string"), f"file://{tmp_path}/w")
    got = {int(r.metadata.fields["page-id"]): r.capture for r in warc.assemble(warc.read(spark, f"file://{tmp_path}/w", payloads=True)).collect()}
    assert {i: (c.kind, None if c.payload is None else bytes(c.payload).decode()) for i, c in got.items()} == {1: ("response", "é" * 60), 2: ("response", "<p>x"), 3: ("revisit", None), 4: ("response", "")}
    assert all(hashlib.sha256(c.payload).hexdigest() == c.payload_digest == c.declared_digest.removeprefix("sha256:") for c in got.values() if c.payload is not None)


def test_decontaminate_short_and_unspaced(spark):
    """Items below the least number of words are found as exact sequences; scripts without spaces are cut into characters."""
    chinese = "质量守恒定律说明反应前后物质的总质量不变"
    docs = spark.createDataFrame([(1, "so it is: Blue-Whale, he said"), (2, "blue sky, whale song"), (3, "他说" + chinese.replace("反应", "变化") + "。再见"), (4, "今天天气很好我们去公园"), (5, "blue"), (6, "whale blue whale blue whale")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "blue whale"), (2, chinese), (3, "--"), (4, "zebra")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in decontaminate.find(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 2), (6, 1)} and got[1, 1] == (1.0, 3, 5) and got[6, 1] == (1.0, 1, 3) and 0.5 <= got[3, 2][0] < 1


def test_decontaminate_chunks(spark):
    """Chunks keep to their bytes and lose no item; what is found does not depend on them."""
    rng = np.random.default_rng(12)
    items = [(i, words(rng, 20)) for i in range(200)]
    bench = spark.createDataFrame([*items, *items[:3]], "item_id bigint, text string")
    got = list(decontaminate.chunks(bench, 2000))
    assert len(got) > 5 and sorted(x for ids, _ in got for x in ids.to_pylist()) == list(range(200))
    assert sum(sum(map(len, texts)) > 2000 for _, texts in got) == 0
    assert list(decontaminate.chunks(bench.limit(0))) == []


def test_warc_reads_members_and_large_pages(spark, tmp_path):
    """One gzip member a record, a plain file, records across pieces; a file is bounded by bytes when written."""
    import gzip

    def record(kind, rid, block, *more):
        head = "".join(f"{k}: {v}\r\n" for k, v in (("WARC-Type", kind), ("WARC-Record-ID", rid), *more, ("Content-Length", len(block))))
        return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"

    answer = b"HTTP/1.1 200 OK\r\n\r\n"
    http = ("Content-Type", "application/http; msgtype=response")
    big = bytes(np.random.default_rng(0).integers(0, 256, 3 << 20, dtype=np.uint8))
    records = [record("warcinfo", "<i>", b"x: y\r\n"), record("response", "<a>", answer + big, http), record("request", "<b>", b"GET / HTTP/1.1\r\n\r\n", ("WARC-Concurrent-To", "<a>"), http), record("response", "<c>", answer, http)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "w" / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "w" / "empty.warc").write_bytes(b"")
    got = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert Counter(r.record_id for r in got) == {"<i>": 2, "<a>": 2, "<b>": 2, "<c>": 2}
    assert {r.payload_digest for r in got if r.record_id == "<a>"} == {hashlib.sha256(big).hexdigest()} and {r.payload_bytes for r in got if r.record_id == "<c>"} == {0}
    whole = b"".join(records)
    for step in (1, 7, 4096):
        cut = [(h["warc-record-id"], len(b)) for h, b in warc.cut_records((records[0] + records[3])[i : i + step] for i in range(0, len(records[0] + records[3]), step))]
        assert cut == [("<i>", 6), ("<c>", len(answer))]
    for bad in (whole[:40], records[0] + b"oops\r\n\r\n", records[1][:-100]):
        with pytest.raises(ValueError):
            list(warc.cut_records([bad]))
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(whole)[:-200]))
    pages = [(i, "u", "x" * (200_000 if i % 3 == 0 else 50) + str(i)) for i in range(120)]
    warc.write(spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1), f"file://{tmp_path}/o")
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "o").glob("*.gz")]
    assert sum(f.count(b"WARC-Type: response") for f in files) == 120 and max(f.count(b"WARC-Type: ") for f in files if len(f) > 200_000) <= 48
    assert warc.round_trip(spark.createDataFrame(pages, "page_id bigint, url string, html string")).count() == 120


def smith_waterman(a, b):
    """Best local score of two word lists, cell by cell."""
    last, best = [0] * (len(a) + 1), 0
    for y in b:
        row = [0]
        for i, x in enumerate(a, 1):
            row.append(max(0, last[i - 1] + (2 if x == y else -1), last[i] - 1, row[-1] - 1))
            best = max(best, row[-1])
        last = row
    return best


def test_decontaminate_hot_seeds(monkeypatch):
    """Items that begin alike, in a text that says it often: the same copies, however few places are held at once."""
    rng = np.random.default_rng(31)
    items = ["which of the following " + words(rng, 8, 400) for _ in range(300)] + [words(rng, 12, 30) for _ in range(40)]
    texts = [" ".join(f"which of the following z{i}" for i in range(60)) + " " + items[7] + " x " + items[9].replace("of", "oh"), words(rng, 500, 30), None, items[3], words(rng, 300, 400)]
    ready = decontaminate.Items(list(range(len(items))), items)
    whole = ready.find(pa.array(texts))
    assert {(0, 7), (0, 9), (3, 3)} <= {x[:2] for x in whole}
    for most in (5, 300, 4000):
        monkeypatch.setattr(decontaminate, "TOGETHER", most)
        assert sorted(ready.find(pa.array(texts))) == sorted(whole)


def test_decontaminate_bounded_seeds():
    """20,000 items with one beginning and a text that has it 400 times take no more room than any text."""
    import tracemalloc

    rng = np.random.default_rng(32)
    items = ["which of the following " + words(rng, 8, 50_000) for _ in range(20_000)]
    ready = decontaminate.Items(list(range(len(items))), items)
    text = " ".join(f"which of the following z{i} y{i}" for i in range(400)) + " " + items[77]
    tracemalloc.start()
    assert [x[1] for x in ready.find(pa.array([text]))] == [77]
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("kind", ["int", "string", "decimal(9,2)", "date"])
def test_decontaminate_item_ids(spark, kind):
    item = "alpha beta gamma delta epsilon zeta eta"
    bench = spark.createDataFrame([("2024-01-01" if kind == "date" else "3", item)], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    got = decontaminate.find(spark.createDataFrame([(1, "x " + item), (2, "y")], "doc_id bigint, text string"), bench)
    assert dict(got.dtypes)["item_id"] == kind and [r.item_id for r in got.collect()] == [bench.first().item_id]


def test_decontaminate_against_brute_force(spark):
    """Every pair of a document and an item, aligned in full: found are those with a trigram in common that reach the threshold."""
    rng = np.random.default_rng(21)
    items = [[f"b{j}x{int(x)}" for x in rng.integers(0, 9, 20)] for j in range(4)]
    rows = []
    for i in range(50):
        w = [f"n{x}" for x in rng.integers(0, 50, int(rng.integers(0, 60)))]
        own = list(items[i % 4])
        for j in rng.integers(0, 20, int(rng.integers(0, 14))):
            own[j] = f"z{i}"
        at = int(rng.integers(0, len(w) + 1))
        rows.append((i, " ".join(w[:at] + own[: int(rng.integers(8, 21))] + w[at:])))
    d = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find(d, bench).collect()}
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(i, j): smith_waterman(t.split(), x) / 40 for i, t in rows for j, x in enumerate(items) if grams(t.split()) & grams(x)}
    assert got == {k: pytest.approx(s) for k, s in want.items() if s >= 0.5} and 5 < len(got) < len(want)


def test_langid_against_exact_sets(spark):
    """Filters against the sets that they stand for: hits of each language from dictionaries of n-grams."""
    rng = np.random.default_rng(3)
    alphabet = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    text = lambda a: " ".join("".join(rng.choice(list(a), int(rng.integers(2, 7)))) for _ in range(40))
    rows = [(i, text(a), n) for i in range(80) for n, a in alphabet.items()] + [(500, text("abcdefghijklmnop"), None), (500, text("abcdefghijklmnop"), None), (501, "Ünï ßø", None), (None, text("abcd"), None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("mine"))
    f = langid.train(d)
    sets = {}
    for n in alphabet:
        df = Counter()
        texts = [t for _, t, m in rows if m == n]
        for t in texts:
            b = f" {t} ".encode()
            df.update({b[i : i + k] for k in langid.SIZES for i in range(len(b) - k + 1)})
        sets[n] = {g for g, c in df.items() if c >= max(2.0, langid.SHARE * len(texts))}
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(d, f).collect()]
    assert len(got) == len(rows)
    by = Counter((i, p) for i, p, _ in got)
    for i, t, _ in rows[:240] + rows[240:242]:
        b = f" {t} ".encode()
        hits = {n: sum(b[j : j + k] in s for k in langid.SIZES for j in range(len(b) - k + 1)) for n, s in sets.items()}
        best = max(sorted(hits), key=lambda n: hits[n])
        if sorted(hits.values())[-1] > sorted(hits.values())[-2] + 3:
            assert by[i, best] >= 1
    with pytest.raises(ValueError):
        langid.train(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(65)], "doc_id bigint, text string, lang string"))


def test_toxicity_against_dense_training(spark):
    """Scores from sets of n-grams, and the weights from dense matrices with the same steps."""
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(rng.choice(["good", "day", "jews", "women", "met", "scum", "fools"], 6).tolist() + (["vermin"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(90)]
    rows += [(7, rows[7][1], 1 - rows[7][2]), (None, "vermin and fools", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    m = toxicity.train(d.withColumn("score", F.lit(5)))
    keep = np.flatnonzero(m.weights)
    ids = [toxicity._ids(pa.array([t]))[0] for _, t, _ in rows]
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    for (i, _, _), own in zip(rows, ids, strict=True):
        if i not in (7, None):
            z = m.bias + m.weights[own].astype(float).sum()
            assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[2]))
    place = {int(k): n for n, k in enumerate(keep)}
    vec = lambda t: np.isin(keep, toxicity._ids(pa.array([t]))[0]).astype(float)
    fitted = toxicity.fit(keep, [np.array([place[int(k)] for k in toxicity._ids(pa.array([t]))[0] if int(k) in place], np.int32) for _, t, _ in order], np.array([y for *_, y in order], float), [[np.array([place[int(k)] for k in toxicity._ids(pa.array([s]))[0] if int(k) in place], np.int32) for s in toxicity.counterfactuals(t)] for _, t, _ in order], 1.0, steps=40)
    x, y = np.array([vec(t) for _, t, _ in order]), np.array([t for *_, t in order], float)
    pairs = [(vec(t), vec(s)) for _, t, _ in order for s in toxicity.counterfactuals(t)]
    gapm = np.array([a - b for a, b in pairs])
    w, bias, m1, m2 = np.zeros(len(keep)), 0.0, np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    for t in range(1, 41):
        g = (1 / (1 + np.exp(-(x @ w + bias))) - y) * each
        grad = np.append(x.T @ g + toxicity.RIDGE * w + gapm.T @ (2 * (gapm @ w) / len(pairs)), g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    assert np.allclose(fitted.weights[keep], w, atol=1e-4)
    assert toxicity.score(d.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        toxicity.scored(d.withColumn("score", F.lit(1)), m)


PLANTED = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, block string, node string, gone string, toxicity string"


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what the one before kept, from planted documents to token digests."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(31)
    base, passage, item = words(rng, 80), words(rng, 60), [f"q{x}" for x in range(25)]
    texts = [words(rng, 90) + (" vile scum vermin" if i % 4 == 0 else "") for i in range(120)]
    texts += [base, base, base + " end", words(rng, 40) + " " + passage, words(rng, 50) + " " + passage + " " + words(rng, 9), words(rng, 30) + " " + " ".join(item), None, "", " ", "one two"]
    rows = [(i, t, "en", "s", len(t or ""), f"mine{i}", "b", "n", "g", "x") for i, t in enumerate(texts)] + [(None, base, "en", "s", 1, "no id", "b", "n", "g", "x")]
    d = spark.createDataFrame(rows, PLANTED)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(110)] + [(3, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {(r.doc_id, r.text, r.score) for r in docs.collect()}
    mine = lambda i, t: (i, t, "no id" if i is None else f"mine{i}")
    clean = {mine(i, t) for i, t in enumerate(texts) if not (i < 120 and i % 4 == 0)} | {mine(None, base)}
    assert kept["toxicity"] == clean
    one = {x for x in clean if x[0] not in (121, 122)}
    assert kept["ngram_jaccard"] == one
    order = sorted(one, key=lambda x: (x[0] is None, x[0] or 0))
    spans = {x[0]: r for x, r in zip(order, removed([x[1] for x in order]), strict=True)}
    want = {mine(x[0], x[1] if not spans[x[0]][1] else spans[x[0]][2].decode()) for x in one}
    assert spans[124][1] == 60 and spans[None][1] == 80 and kept["substring"] == want
    assert {r.doc_id: r.n_chars for r in spark.read.parquet(f"{tmp_path}/substring").collect()}[124] == len(dict((x[0], x[1]) for x in want)[124])
    want = {x for x in want if x[0] != 125}
    assert kept["decontaminate"] == want
    t = Tokenizer.from_file(BPE)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    ids = {x[0]: t.encode(x[1] or "", add_special_tokens=False).ids for x in want}
    assert got == {i: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for i, x in ids.items()}
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
