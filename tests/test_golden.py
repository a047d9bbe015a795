"""A generated corpus against its manifest, twice; and the matching of items against plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from tests.golden_corpus import DEFECTS, MANIFEST, corpus, manifest
from veritab.operators import golden
from veritab.plans.run import run_pipeline


@pytest.fixture(scope="module")
def run(spark):
    made = corpus(spark)
    return made, run_pipeline(made["items"], made["descriptors"])


def test_all_planted_items(spark, run):
    _, result = run
    items = spark.createDataFrame(manifest(), MANIFEST)
    judged = golden.outcomes(result.findings, items, result.arithmetic, result.entities)
    assert len(DEFECTS) == 48 and [(r.id, r.found, r.confidence) for r in judged.where("NOT met OR met IS NULL").collect()] == []
    assert {r.kind: (r.items, r.met, r.recall) for r in golden.recall(judged).collect()} == {"FINDING": (48, 48, 1.0), "DECOY": (3, 3, 1.0), "TRUE_NEGATIVE": (4, 4, 1.0)}
    assert golden.precision(result.findings, items).first().asDict() == {"sure": 48, "planted": 48, "precision": 1.0}


def test_what_is_not_there_is_not_met(spark, run):
    """Another severity, scope, text or concept, a decoy that is sure, a check that fails, too many references."""
    _, result = run
    rows = [
        ("severity", "", "FINDING", "MINOR", "coding.meddra_version", None, None, None, None), ("scope", "", "FINDING", "MAJOR", "coding.meddra_version", "INTRA_DOCUMENT", None, None, None),
        ("text", "", "FINDING", "MAJOR", "coding.meddra_version", None, "MedDRA 20", None, None), ("concept", "", "FINDING", "MAJOR", "coding.none", None, None, None, None), ("unsure", "", "FINDING", "MINOR", "dose.regimen", None, None, None, None),
        ("sure", "", "DECOY", "MINOR", "standard.spelling.separate", None, None, None, None), ("failed", "", "TRUE_NEGATIVE", None, None, None, None, "Equivalence margin", None), ("unknown", "", "TRUE_NEGATIVE", None, None, None, None, "no such check", None),
        ("references", "", "TRUE_NEGATIVE", None, None, None, None, None, 99), ("kind", "", "OTHER", None, None, None, None, None, None), ("nothing", "", "TRUE_NEGATIVE", None, None, None, None, None, None)]
    got = {r.id: (r.found, r.met) for r in golden.outcomes(result.findings, spark.createDataFrame(rows, MANIFEST), result.arithmetic, result.entities).collect()}
    assert got == {"severity": (1, False), "scope": (0, False), "text": (0, False), "concept": (0, False), "unsure": (1, False), "sure": (1, False), "failed": (1, False), "unknown": (0, False), "references": (1, False), "kind": (0, None), "nothing": (0, None)}


def test_a_second_run_finds_the_same(spark, run):
    """Other partitions of the items, and other partitions of every shuffle."""
    made, result = run
    first = [tuple(r) for r in result.findings.orderBy(F.length("id"), "id").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = run_pipeline(made["items"].orderBy(F.rand(5)).repartition(11), made["descriptors"].repartition(3))
        assert [tuple(r) for r in again.findings.orderBy(F.length("id"), "id").collect()] == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_page_map_is_what_ingest_finds(run):
    made, result = run
    documents = {r.documentId: (r.pdfPageCount, r.printedPageCount, r.pageOffset) for r in result.documents.collect()}
    assert {r.documentId: (r.pdfPages, r.printedPages, r.pageOffset) for r in made["page_map"].collect()} == documents


def test_matches_like_plain_comparison(spark):
    """Random texts of few letters, one concept with most findings, short, empty and null texts, letters beyond 16 bits."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab é𝒳") for _ in range(n))
    findings = [(f"F-{i}", rng.choice(["hot"] * 5 + ["b", "c", None]), rng.choice(["X", "Y", None]), rng.choice([word(rng.randint(0, 40)), word(12), None])) for i in range(3000)]
    items = [(i, rng.choice(["hot", "b", "c", None]), rng.choice(["X", None]), rng.choice([None, "", word(1), word(2), word(3), word(5), word(5)])) for i in range(80)]
    got = golden.matches(spark.createDataFrame(findings, "id string, conceptKey string, scope string, said string"), spark.createDataFrame(items, "item int, conceptKey string, scope string, evidence string"))
    expected = sorted((i, f) for i, ic, isc, e in items for f, fc, fs, s in findings if ic is not None and ic == fc and (isc is None or isc == fs) and s is not None and (e or "") in s)
    assert sorted((r.item, r.id) for r in got.collect()) == expected


def test_nothing_to_match(spark, run):
    _, result = run
    none = spark.createDataFrame([], MANIFEST)
    assert golden.outcomes(result.findings, none, result.arithmetic, result.entities).count() == 0 and golden.recall(golden.outcomes(result.findings, none)).count() == 0
    assert golden.precision(result.findings.limit(0), none).first().asDict() == {"sure": 0, "planted": 0, "precision": None}
    one = spark.createDataFrame([manifest()[0], manifest()[0]], MANIFEST)
    assert [(r.found, r.met) for r in golden.outcomes(result.findings.limit(0), one).collect()] == [(0, False)] * 2


def test_every_reason_is_told():
    """Whatever a finding is on, its context and its action are long enough to stand for a reader."""
    from veritab.operators.profiles import CONTEXT, FAMILIES

    assert all(len(why) > golden.CONTEXT_LENGTH and len(what) + 2 > golden.ACTION_LENGTH for _, why, what in FAMILIES) and all(len(x) > golden.CONTEXT_LENGTH for x in CONTEXT.values())
