"""The divergence audit against a brute force, with the defined cases."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lotewise.llm import common, divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, v bigint, g bigint, value double"


def brute(rows, least=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs, groups, totals = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = words(text)
        docs[lang or ""].update(set(w))
        totals[lang or ""].update(w)
        groups[lang or "", source or ""].update(w)
    kept = {x: [t for t, c in n.items() if c >= least] for x, n in docs.items()}
    share = lambda counts, lang: {t: 1 + 10**9 * (counts[t] + 1) // (sum(counts[u] for u in kept[lang]) + len(kept[lang])) for t in kept[lang]}
    out = set()
    for (lang, source), counts in groups.items():
        p, q = share(counts, lang), share(totals[lang], lang)
        pairs = []
        for (other, item), theirs in groups.items():
            if other == lang and item != source:
                o = share(theirs, lang)
                pairs.append((item, sum((p[t] - o[t]) ** 2 // o[t] for t in kept[lang])))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept[lang] if counts[t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.fixture(scope="module")
def rows():
    some = ["The cat and THE dog", "the été, l'été; naïve_naive 日本 the", "a b\x00c\x7fd 12x34 the", None, "", " \t\n 42", "cat " * 3000 + "é\U0001F642é dog", "dog.cat.the.the", "İstanbul ſ K the"]
    out = [(t, lang, source) for i, t in enumerate(some * 3) for lang, source in [(["en", "fr", None][i % 3], ["s1", "s2", None, "ß"][i % 4])]]
    out += [("same words here", "en", "hot")] * 40  # a group of copies
    out += [("only once", "xx", "s1"), (None, "xx", "s2"), ("twice", "yy", "z")]  # languages that keep no term
    return out


def frame(spark, rows):
    common.prepare(spark)
    return spark.createDataFrame([(None if i % 5 == 0 else i // 2, t, x, s, "t", 1, 2, 3, 0.5) for i, (t, x, s) in enumerate(rows)], SCHEMA).repartition(3)


def test_audit(spark, rows):
    got = divergence.audit(frame(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert ("xx", "s1", "pair", "s2", 0, 1) in found


def test_limits(spark, rows, monkeypatch):
    monkeypatch.setattr(divergence, "ROWS_OUT", 3)
    assert {tuple(r) for r in divergence.audit(frame(spark, rows), least=1, top=2).collect()} == brute(rows, 1, 2)
    counts = divergence._Counts()
    import pyarrow as pa

    counts.add(["en"] * 2, ["s"] * 2, pa.array(["b a", "a a"]))
    assert counts.size() == 2 and [r for b in counts.rows() for r in b.to_pylist()] == [{"lang": "en", "source": "s", "term": "b", "n": 1, "docs": 1}, {"lang": "en", "source": "s", "term": "a", "n": 3, "docs": 2}]


def test_wide_counts(spark):
    wide = spark.range(1).select(F.lit(10**13).alias("n"), F.lit(3 * 10**13).alias("total"), F.lit(7).alias("v"))
    assert wide.select(divergence.share("n", "total")).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


def test_empty(spark, rows):
    assert divergence.audit(frame(spark, rows).limit(0)).count() == 0
