"""Golden runs: facts to findings, with the figures worked out by hand."""

import pytest

from tests.helpers import paragraphs, rows_of
from veritab.model import ABBREVIATIONS, SECTIONS
from veritab.plans.run import analyse


@pytest.fixture(scope="module")
def result(spark):
    rows = rows_of(
        "279 evaluable subjects per treatment group. With a dropout rate of 10 % this means that 310 subjects per treatment group are required.",
        "A total of 620 subjects will be randomised.",
        "The margin is derived as 50% of the lower bound of the interval. The estimated effect is 26% and the resulting margin is therefore 15%.",
        "Visits may shift ±3 days. Other visits may shift ±7 days.",
        "The confirmatory dose of 6 mg/kg every 21 days.",
        "No statistical comparison between treatment groups will be performed for safety data. Safety data are compared with Fisher's exact test.",
        "The two-sided 90% confidence interval for the ratio lies within [0.80, 1.25]. The two-sided 95% confidence interval for the difference lies within [-10, 10].",
        "A seperate list. The planned cycle interval of 21 days holds; the planned dose is 6 mg/kg, giving 0.29 a day.",
        doc="P", doc_type="SAP", seq=1)
    rows += rows_of(
        "A total of 655 subjects were randomised.",
        "30 days after the last dose. In the phase 1 study a dose of 8 mg/kg every 21 days was given.",
        "The observed ratio of rates was 1.02 with a two-sided 90% confidence interval of 0.91 to 1.14. The observed difference of rates was 4 with a two-sided 95% confidence interval of -3 to 12.",
        "Randomised subjects by geographic region\nAsia 100 110 210\nEurope 210 235 445\nTotal 310 345 655",
        doc="R", doc_type="CSR", seq=2)
    rows += rows_of("28 days after the final dose. A baseline ECG is done at screening and at surgery.", doc="T", doc_type="PROTOCOL", seq=0)
    rows += rows_of("The ECG form is filled in at screening. 28 days after the last dose.", doc="C", doc_type="CRF", seq=3)
    none = spark.createDataFrame([], ABBREVIATIONS), spark.createDataFrame([], SECTIONS)
    run = analyse(paragraphs(spark, rows), none[1], none[0])
    return {r.conceptKey: r for r in run.findings.collect()}, run.arithmetic.collect(), run.findings.orderBy("id").collect(), run.entities.collect()


def test_cross_and_within(result):
    f = result[0]
    assert f["safety.followup_window"].scope == "CROSS_DOCUMENT" and f["safety.followup_window"].severity == "MAJOR"
    assert f["safety.followup_window"].documentTypes == ["PROTOCOL", "CSR", "CRF"]
    # .30 + .3 * .93 rounded to .28 + .15 + .15 (28 days in two types) + .10
    assert f["safety.followup_window"].confidence == pytest.approx(0.95)
    assert f["schedule.visit_window"].scope == "INTRA_DOCUMENT" and "+/-3 days / +/-7 days" in f["schedule.visit_window"].title


def test_declared_checks(result):
    f = result[0]
    pair = f["sample_size.planned~sample_size.randomised"]
    assert pair.severity == "CRITICAL" and "620 planned, 655 reported" in pair.title
    assert f["policy.safety_testing_contradiction"].severity == "MAJOR" and f["policy.safety_testing_contradiction"].benignNote
    assert f["equivalence.criteria_verdict"].severity == "CRITICAL" and "difference not met, ratio met" in f["equivalence.criteria_verdict"].description
    assert f["standard.spelling.separate"].severity == "MINOR"
    assert f["assessment.ecg.surgery"].category == "COVERAGE" and "assessment.ecg.screening" not in f


def test_benign_dose_is_kept_but_low(result):
    dose = result[0]["dose.regimen"]
    assert dose.severity == "MINOR" and dose.confidence < 0.5 and dose.benignNote


def test_arithmetic(result):
    by = {c.label: c for c in result[1]}
    assert len(result[1]) == 3 + 2 + 1 + 1 + 1 and [c.id for c in sorted(result[1], key=lambda c: c.id)][0] == "AC-001"
    failed = [c for c in result[1] if c.outcome == "FAILED"]
    assert [c.label for c in failed] == ["Equivalence margin follows from its derivation"] and failed[0].expected == "13.00%"
    assert by["Planned dose intensity for 6 mg/kg"].outcome == "CONFIRMED"
    # .45 + .30 + .15, no corroboration
    assert result[0]["design.equivalence_margin"].confidence == pytest.approx(0.90)


def test_order_and_factors(result):
    findings = result[2]
    rank = {"CRITICAL": 0, "MAJOR": 1, "MINOR": 2}
    keys = [(rank[f.severity], -f.confidence) for f in findings]
    assert keys == sorted(keys) and [f.id for f in findings] == [f"F-{i + 1:03d}" for i in range(len(findings))]
    for f in findings:
        assert abs(sum(x.contribution for x in f.confidenceFactors) - f.confidence) < 0.08 or f.confidence in (0.05, 0.95)
        assert f.occurrences and f.regulatoryContext and f.suggestedAction


def test_entities_are_dense(result):
    seq = sorted(e.entitySeq for e in result[3])
    assert seq == list(range(1, len(seq) + 1))


def test_a_run_says_what_it_does(spark, tmp_path):
    """Six stages with counters, and the run's events, in order."""
    from veritab.model import DESCRIPTORS, ITEMS
    from veritab.operators.review import AuditLog
    from veritab.plans.run import STAGES, Runner
    from veritab.sources.fixtures import Block, item_rows
    from veritab.sources.readers import with_order

    rows = item_rows("P", [Block("heading", "1 Design"), Block("para", "A total of 620 subjects will be randomised.")], "Header P") + item_rows("R", [Block("heading", "1 Results"), Block("para", "A total of 655 subjects were randomised.")], "Header R")
    descriptors = with_order(spark.createDataFrame([("P", "SAP", "p.pdf", "Plan", "v1.0", "", ""), ("R", "CSR", "r.pdf", "Report", "v1.0", "", "")], DESCRIPTORS))
    log, said, runner = AuditLog(spark, str(tmp_path / "log")), [], Runner()
    out = runner.run(spark.createDataFrame(rows, ITEMS), descriptors, on_stage=lambda stage, counters: said.append((stage, counters)), log=log, timestamp="2024-01-01T00:00:00Z")
    assert runner.state == "READY" and out is runner.result and tuple(s for s, _ in said) == STAGES
    counters = dict(said)
    assert counters["INGEST"] == {"documents": 2, "pages": 4} and counters["DEBOILERPLATE"]["rotatedItems"] == 8 and counters["DEBOILERPLATE"]["linesRemoved"] == 4
    assert counters["STRUCTURE"]["paragraphs"] >= 4 and counters["EXTRACT"] == {"entities": 2, "concepts": 2} and counters["SCORE"]["findings"] == 1
    assert [r.eventType for r in log.events().orderBy("id").collect()] == ["DOCUMENT_INGESTED", "DOCUMENT_INGESTED", "EXTRACTION_COMPLETED", "ANALYSIS_COMPLETED"]
    assert "2 pages, 1 printed, offset 1" in log.events().orderBy("id").first().detail
    with pytest.raises(Exception):
        runner.run(None, None)
    assert runner.state == "FAILED" and runner.error is not None


def test_declared_pairs_are_the_callers(spark):
    from pyspark.sql import functions as F

    from veritab.operators import compare

    rows = rows_of("Visits may shift ±3 days.", doc="P", doc_type="SAP", seq=1) + rows_of("30 days after the last dose.", doc="R", doc_type="CSR", seq=2)
    pair = compare.RelatedPair("schedule.visit_window", "safety.followup_window", False, lambda l, r: l != r, lambda l, r: F.concat(l, F.lit(" and "), r), lambda l, r: F.lit("They differ."))
    none = spark.createDataFrame([], ABBREVIATIONS), spark.createDataFrame([], SECTIONS)
    found = analyse(paragraphs(spark, rows), none[1], none[0], pairs=(pair,), coverage=(compare.Coverage("safety.", "CSR", "SAP"),)).findings.collect()
    assert {(f.conceptKey, f.title) for f in found} == {("schedule.visit_window~safety.followup_window", "+/-3 days and 30 days"), ("safety.followup_window", "Safety follow-up — required by CSR, absent from SAP")}
    assert all(f.regulatoryContext and f.suggestedAction for f in found)


def test_policies_share_their_documents_tests(spark):
    """Evidence of policies grows with policies and with tests, not with both at once; findings and occurrences are those of all facts."""
    from veritab.operators import compare

    policy, names = "No statistical comparison between treatment groups will be performed for safety data.", ["Fisher's exact test", "chi-squared test", "t-test"]
    rows = []
    for section in ("1", "2", "3"):
        rows += rows_of(*[policy] * 4, *[f"Safety data are compared with the {name}." for name in names * 3], doc="P", doc_type="SAP", seq=1, section=section)
    none = spark.createDataFrame([], ABBREVIATIONS), spark.createDataFrame([], SECTIONS)
    run = analyse(paragraphs(spark, rows), none[1], none[0])
    policies, tests = 12, 27
    whole, summed = compare.policy_evidence(run.entities), [e for e in compare.all_evidence(run.entities, run.arithmetic, run.documents) if e.where("draft LIKE 'policy|%'").count()]
    assert whole.count() == policies * (1 + tests)
    assert [e.count() for e in summed] == [policies * (1 + len(names))]
    heads = lambda e: {r.draft: r for r in compare.drafts_of(e).drop("occurrenceCount").collect()}
    assert heads(summed[0]) == heads(whole) and len(heads(whole)) == policies
    gathered = sorted(r.occurrences for r in compare.drafts_of(whole, gathered=True).collect())
    found = run.findings.where("conceptKey = 'policy.safety_testing_contradiction'")
    assert sorted(r.occurrences for r in found.collect()) == gathered and {len(o) for o in gathered} == {1 + 3 * len(names)}
    assert "Join" not in run.findings.select("id", "title")._jdf.queryExecution().optimizedPlan().toString()
