"""Value findings: the same evidence as by the relational operators one by one, and little left on disk."""

import os
import random

from pyspark.sql import functions as F

from tests.conftest import SF
from veritab.operators import compare, relational
from veritab.plans.finding_queries import fact_rows, value_findings
from veritab.plans.scratch import shared_dir


def _facts(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([f"vocabulary.t{rng.randrange(12)}", "acronym.A"]), rng.choice(["a", "A", "b", None]), f"D{rng.randrange(4)}", rng.choice(["SAP", "CSR"]), str(rng.randrange(3)), rng.choice([None, None, "downgrade", "mitigate"])) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, concept string, value string, doc string, type string, section string, mode string")
    return fact_rows(df, seq=F.col("seq"), concept=F.col("concept"), category=F.lit("TERMINOLOGY"), value=F.col("value"), document=F.col("doc"), doc_type=F.col("type"), section=F.col("section"), mode=F.col("mode")).repartition(5)


def _one_by_one(facts):
    mode = F.col("benign.mode")
    down = F.coalesce(mode == "downgrade", F.lit(False))
    within = facts.join(relational.disagreeing(facts, ["conceptKey", "documentId"], "normalizedValue").select("conceptKey", "documentId"), ["conceptKey", "documentId"], "left_semi").withColumn("draft", F.concat_ws("|", F.lit("intra"), "conceptKey", "documentId"))
    settled = relational.cross_drift(facts, "conceptKey", "documentId", "normalizedValue", "entitySeq", down)
    across = facts.join(settled, ["conceptKey", "documentId"]).where(F.col("normalizedValue") == F.col("consensus")).drop("consensus").withColumn("draft", F.concat_ws("|", F.lit("cross"), "conceptKey"))
    rows = within.unionByName(across)
    modes = relational.benign_mode(rows, ["draft"], "normalizedValue", mode).withColumnRenamed("benign", "kept")
    return rows.join(modes, "draft").select("draft", "entitySeq", "kept", F.when(mode == F.col("kept"), F.col("benign.note")).alias("note"))


def test_evidence_is_as_the_operators_say(spark):
    for seed in range(3):
        facts = _facts(spark, seed).cache()
        own = compare.value_evidence(facts).select("draft", "entitySeq", F.col("benign").alias("kept"), "note")
        assert sorted(own.collect(), key=str) == sorted(_one_by_one(facts).collect(), key=str)


def test_occurrences_are_counted_as_they_are_gathered(spark):
    rows = compare.value_evidence(_facts(spark, 7)).cache()
    counted = {r.draft: r for r in compare.drafts_of(rows).collect()}
    gathered = {r.draft: r for r in compare.drafts_of(rows, gathered=True).collect()}
    assert counted.keys() == gathered.keys() and counted
    expected = {r.draft: r.n for r in rows.groupBy("draft").agg(F.count_distinct(F.struct("documentId", F.coalesce("normalizedValue", F.lit("-")), "citation.sectionId")).alias("n")).collect()}
    for draft, r in gathered.items():
        assert len(r.occurrences) == r.occurrenceCount == counted[draft].occurrenceCount == expected[draft]
        assert r.title == counted[draft].title and r.confidence == counted[draft].confidence


def test_little_is_left_on_disk(spark):
    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(shared_dir(spark)) for f in files)

    before = size()
    rows = value_findings(spark, SF)
    assert rows.count() > 100
    assert size() - before < 60 * spark.read.parquet(f"{SF}/lineitem.parquet").count()  # bytes a line; findings themselves were left there, uncompressed
