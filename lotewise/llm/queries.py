"""The queries of the operators, by contract, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clustering, decontaminate, divergence, jaccard_join, katz, langid, packing, sharding, substring_dedup, toxicity, warc
from .common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out_of_fold = langid.held_out(3, 1)
    model = toxicity.train(docs.select("doc_id", "text").join(labels.select("doc_id", "toxic").where(~out_of_fold), "doc_id"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out_of_fold.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    filters = langid.train(docs.where(~langid.held_out(4, 2)))
    out = langid.predict(docs, filters)
    return out.select("doc_id", langid.held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clusters(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_substring": op4_substring,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_hnsw": op7_hnsw,
    "op8_katz": op8_katz,
    "op9_decontaminate": op9_decontaminate,
    "op10_langid": op10_langid,
    "op11_divergence": op11_divergence,
    "op12_packing": op12_packing,
    "op13_clustering": op13_clustering,
}

def _rounds_sql(rounds: int) -> str:
    """The rounds of op13 one after another: vectors v, their components e, and for each round distances, places and centroids."""
    parts = [
        """WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), e AS MATERIALIZED (
            SELECT r, unnest(range(64)) AS d, unnest(c) AS x FROM v
        ), f AS MATERIALIZED (
            SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM v QUALIFY k < 8
        ), c0 AS MATERIALIZED (
            SELECT k, d, x FROM f JOIN e USING (r)
        )"""
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS MATERIALIZED (
            SELECT r, k, sum((e.x - c.x) * (e.x - c.x)) AS far FROM e JOIN c{i} c ON e.d = c.d GROUP BY r, k
        ), a{i} AS MATERIALIZED (
            SELECT r, k, far FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, k) = 1
        )""")
        if i < rounds:
            parts.append(f"""s{i} AS MATERIALIZED (
                SELECT k, d, sum(x) AS s, count(*)::HUGEINT AS n FROM a{i} JOIN e USING (r) GROUP BY k, d
            ), c{i + 1} AS MATERIALIZED (
                SELECT k, d, CAST(coalesce((s - ((s % n) + n) % n) // n, x) AS BIGINT) AS x FROM c{i} LEFT JOIN s{i} USING (k, d)
            )""")
    last = f"""SELECT v.vec_id, CAST(a.k AS INT) AS cluster, CAST(a.far AS BIGINT) AS distance, CAST(sum(a.far) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
        CAST(sum(a.far) OVER () AS BIGINT) AS inertia, h.sha AS centroid_sha256
        FROM a{rounds} a JOIN v USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS sha FROM c{rounds} GROUP BY k) h ON h.k = a.k"""
    return ", ".join(parts) + " " + last


SQL: dict[str, str] = {
    "op2_jaccard": """
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), g AS (
            SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS i FROM d WHERE len(words) > 0
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i + 1 : i + 5], ' ') AS key FROM g
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), o AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.key = b.key AND a.doc_id <> b.doc_id GROUP BY ALL
        ), e AS (
            SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
        ), r AS (
            SELECT a AS doc_id, b AS other FROM e
            UNION
            SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
        )
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.other, d.doc_id)) AS BIGINT) AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS other FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
    """,
    "op4_substring": """
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
        ), w AS (
            SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
        ), g AS (
            SELECT doc_id, unnest(range(len(words) - 19)) AS i, words FROM d WHERE len(words) >= 20
        ), k AS (
            SELECT doc_id, i, array_to_string(words[i + 1 : i + 20], ' ') AS key FROM g
        ), late AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM k) WHERE n > 1
        ), gone AS (
            SELECT DISTINCT doc_id, i + o AS i FROM late, (SELECT unnest(range(20)) AS o)
        ), kept AS (
            SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.i = gone.i GROUP BY w.doc_id
        )
        SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(len(d.words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
    """,
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
               CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
    """,
    "op11_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
        ), k AS (
            SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
        ), l AS (
            SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang
        ), g AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
        ), t AS (
            SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source
        ), p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
                   1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
                   1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
            FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang
            LEFT JOIN t ON g.lang = t.lang AND g.source = t.source
            LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
        ), s AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), e AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
        FROM e QUALIFY part = 'pair' OR rank <= 200
    """,
    "op13_clustering": _rounds_sql(clustering.ROUNDS),
}
