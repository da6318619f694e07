"""Training samples keep to their bounds, whatever the ids."""

from pyspark.sql import functions as F

from lotewise.llm import common, langid, sampling, toxicity


def test_bounded(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 20_000).cast("string")).alias("text"), F.when(F.col("id") < 30, "rare").otherwise("often").alias("lang"))
    rows = rows.unionByName(spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same").alias("text"), F.lit("copies").alias("lang")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = {"rare": 20, "often": 700, "copies": 90}
    got = {r["lang"]: r["n"] for r in sampling.bounded(rows, ["doc_id", "text"], "lang", most, counts).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got["often"] == 700 and 10 <= got["rare"] <= 20 and got.get("copies", 0) in (0, 90)
    same = sampling.bounded(rows.repartition(7), ["doc_id", "text"], "lang", most, counts)
    assert sorted(r.text for r in same.where("lang = 'often'").collect()) == sorted(r.text for r in sampling.bounded(rows, ["doc_id", "text"], "lang", most, counts).where("lang = 'often'").collect())
    assert sampling.bounded(rows, ["doc_id", "text"], "lang", {}, {}).count() == 0
    assert sampling.bounded(rows, ["doc_id", "text"], "lang", counts, counts).count() == 45_000


def test_rows_without_an_id(spark, monkeypatch):
    """30,000 labelled rows without an id: what is learnt from keeps to the documented numbers."""
    common.prepare(spark)
    kept = {}

    def noted(module):
        store = module.stored

        def keep(df, what):
            out = store(df, what)
            kept[what] = out.count()
            return out

        monkeypatch.setattr(module, "stored", keep)

    noted(langid)
    noted(toxicity)
    word = F.when(F.col("id") % 2 == 0, "good morning dear friend ").otherwise("guten Morgen lieber Freund ")
    rows = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(word, F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), (F.col("id") % 2).cast("int").alias("toxic"))
    filters = langid.train(rows.drop("toxic"), sample=600)
    assert kept["languages"] <= 2 * 600 + 4 and filters.languages == ["de", "en"]
    toxicity.train(rows.drop("lang"), sample=500)
    assert 400 < kept["labelled"] <= 500
