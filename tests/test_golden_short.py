"""Short texts of planted items are sought where findings are: what a concept holds is not gathered as pairs first."""

from pyspark.sql import functions as F

from veritab.operators import golden, relational


def test_pairs_that_do_not_fit_are_not_stored(spark, monkeypatch):
    findings = spark.range(2000).select(F.concat(F.lit("F-"), "id").alias("id"), F.lit("c").alias("conceptKey"), F.lit("S").alias("scope"), F.when(F.col("id") % 100 == 0, "7 of them").otherwise("none").alias("said"), F.col("id").alias("n"))
    items = spark.range(20).select(F.col("id").alias("item"), F.lit("c").alias("conceptKey"), F.lit(None).cast("string").alias("scope"), F.lit("7").alias("evidence"))
    stored, cut = [], relational.cut
    monkeypatch.setattr(relational, "cut", lambda df: (lambda out: (stored.append(out.count()), out)[1])(cut(df)))
    fit = golden.matches(findings, items, ["n"])
    assert max(stored) <= 2000
    assert sorted({(r.item, r.n) for r in fit.collect()}) == [(i, n) for i in range(20) for n in range(0, 2000, 100)]
