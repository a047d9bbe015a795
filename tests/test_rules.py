"""One case that fires and one near miss for each rule."""

import pytest

from tests.helpers import paragraphs, rows_of
from veritab.model import ABBREVIATIONS, SECTIONS
from veritab.operators.catalogue import BY_ID, RULES
from veritab.plans.run import RuleExtractor

# rule, text that fires, {concept: value}, text that does not, paragraph options
CASES = [
    ("numeric.sample_size.planned", "A total of 1,240 subjects will be randomised.", {"sample_size.planned": "1240"}, "A total of 1,240 subjects were screened.", {}),
    ("numeric.sample_size.planned", "Randomised n = 300 n = 300 n = 600", {"sample_size.planned": "600"}, "Randomised n = 300", {}),
    ("numeric.sample_size.planned_per_arm", "310 subjects per treatment group are required.", {"sample_size.planned_per_arm": "310"}, "310 subjects are required.", {}),
    ("numeric.sample_size.evaluable", "279 evaluable subjects per treatment group", {"sample_size.evaluable_per_arm": "279"}, "279 evaluable subjects", {}),
    ("numeric.dropout_rate", "a dropout rate of 10 % is assumed", {"design.dropout_rate": "10%"}, "the dropout was 10 %", {}),
    ("numeric.sample_size.randomised", "A total of 655 subjects were randomised.", {"sample_size.randomised": "655"}, "A total of 655 subjects will be randomised.", {}),
    ("numeric.sample_size.randomised", "Randomised subjects by geographic region\nAsia 10 20 30\nTotal 310 345 655", {"sample_size.randomised": "655"}, "Subjects by age\nTotal 310 345 655", {}),
    ("numeric.sample_size.treated", "650 subjects received at least one dose", {"sample_size.treated": "650"}, "650 subjects received a dose", {}),
    ("numeric.sample_size.per_protocol", "The Per-Protocol Set comprised 600 subjects, 290 in the test group and 310 in the other.", {"sample_size.per_protocol": "600"}, "The Per-Protocol Set comprised 600 subjects.", {}),
    ("numeric.dose_regimen", "a maintenance dose of 6 mg/kg every 21 days", {"dose.regimen": "6 mg/kg Q21D"}, "a maintenance dose of 6 mg", {}),
    ("numeric.dose_regimen", "which was 2.50 mg/kg administered once weekly", {"dose.regimen": "2.5 mg/kg QW"}, "which was 2.5 mg/kg", {}),
    ("numeric.sample_size.pk", "twenty-four subjects per treatment group provide 80% power", {"sample_size.pk_per_arm": "24"}, "some subjects per treatment group provide 80% power", {}),
    ("statistical.alpha", "tested at a one-sided significance level of 0.025", {"stat.alpha": "alpha 0.025 (one-sided)"}, "a one-sided level of 0.025", {}),
    ("statistical.alpha", "Tests are two-sided and conducted at a significance level of 5 %.", {"stat.alpha": "alpha 0.05 (two-sided)"}, "Tests are two-sided.", {}),
    ("statistical.power", "gives 90% power", {"stat.power": "90%"}, "gives much power", {}),
    ("statistical.default_ci_level", "all confidence intervals will be two-sided 95% confidence intervals", {"stat.default_ci_level": "95% CI (two-sided)"}, "confidence intervals will be wide", {}),
    ("statistical.equivalence_criterion", "the two-sided 90% confidence interval for the ratio lies within [0.80, 1.25]", {"equivalence.ci_level.ratio": "90% CI (two-sided)"}, "within [0.80, 1.25]", {}),
    ("statistical.ci_level_for_statistic", "a two-sided 95% confidence interval for the difference", {"equivalence.ci_level.difference": "95% CI (two-sided)"}, "the observed difference and a two-sided 95% confidence interval for the difference", {}),
    ("statistical.observed_interval", "The observed ratio of rates was 1.02 with a two-sided 90% confidence interval of 0.91 to 1.14", {"equivalence.observed.ratio": "1.02 (90% CI 0.91 to 1.14)"}, "The observed ratio was 1.02", {"doc_type": "CSR"}),
    ("statistical.equivalence_margin_derivation", "The margin is derived as 50% of the lower bound of the interval. The estimated effect is 26% and the resulting margin is therefore 15%.", {"design.equivalence_margin": "15%"}, "The margin is 15%.", {}),
    ("statistical.test_for_safety_data", "Safety data are compared with Fisher's exact test", {"practice.statistical_test_on_safety_data": "Fisher's exact test"}, "Efficacy is compared with a t-test", {}),
    ("statistical.no_comparison_policy", "No statistical comparison between treatment groups will be performed for safety data", {"policy.no_statistical_comparison.safety": "STATED"}, "No comparison will be performed", {}),
    ("population.ecog_eligibility", "Inclusion: ECOG performance status of 0 or 1", {"inclusion.ecog": "ECOG 0-1"}, "Inclusion: ECOG was recorded", {}),
    ("population.ecog_reporting_scale", "ECOG performance status is shown in categories (0, 1, 2)", {"reporting.ecog_scale": "ECOG categories 0, 1, 2"}, "ECOG performance status is shown", {}),
    ("population.pk_set_cycle_requirement", "The pharmacokinetic set received at least four cycles", {"population.pk_set.cycle_requirement": "GTE 4 cycles"}, "The safety set received at least four cycles", {}),
    ("population.pps_site_exclusion", "Twelve subjects enrolled at two sites in Utopia are excluded from the Per-Protocol Set", {"population.pps_site_exclusion": "12 subjects at 2 sites in Utopia"}, "Twelve subjects are excluded from the Per-Protocol Set", {}),
    ("population.creatinine_clearance", "creatinine clearance ≥ 60 mL/min", {"inclusion.creatinine_clearance": "GTE 60 mL/min"}, "creatinine clearance is measured", {}),
    ("population.lvef_threshold", "baseline left ventricular ejection fraction of at least 55 %", {"inclusion.lvef_baseline": "GTE 55 %"}, "left ventricular ejection fraction at baseline", {}),
    ("population.min_age", "aged at least eighteen years", {"inclusion.min_age": "GTE 18 years"}, "aged at least several years", {}),
    ("schedule.visit_window", "Visits may shift ±3 days", {"schedule.visit_window": "+/-3 days"}, "Visits may shift 3 days", {}),
    ("schedule.safety_followup", "30 days after the last dose", {"safety.followup_window": "30 days"}, "30 days after the first dose", {}),
    ("schedule.cycle_interval", "at 21-day intervals", {"schedule.cycle_interval": "21 days"}, "at long intervals", {}),
    ("schedule.neoadjuvant_cycles", "a neoadjuvant period of eight cycles", {"schedule.cycles.neoadjuvant": "8 cycles"}, "a neoadjuvant period", {}),
    ("coverage.assessment_timepoint", "An ECG is done at screening and on Cycle 2 Day 1. Blood is drawn at surgery.", {"assessment.ecg.screening": "REQUIRED", "assessment.ecg.c2d1": "REQUIRED"}, "An ECG is done often.", {"doc_type": "PROTOCOL"}),
    ("terminology.grading_scale", "graded by CTCAE v4.0", {"safety.ae_grading_scale": "CTCAE 4.0"}, "graded by CTCAE", {}),
    ("terminology.dictionary_version", "coded with MedDRA version 18.1", {"coding.meddra_version": "MedDRA 18.1"}, "coded with MedDRA", {}),
    ("terminology.controlled_vocabulary", "the Full analysis Set", {"vocabulary.full_analysis_set": "Full analysis Set"}, "the full set", {}),
    ("derivation.identifier_spelling", "if trtgrp then aval = trtgrpn;", {"derivation.identifier.trtgrp": "trtgrp", "derivation.identifier.trtgr": "trtgrpn", "derivation.identifier.vl": "aval"}, "if then else;", {"kind": "CODE"}),
    ("derivation.stray_token", "data a;\n 42 \nrun;", {"derivation.code_hygiene": 'STRAY LITERAL "42"'}, "data a;\nrun;", {"kind": "CODE"}),
    ("derivation.dose_intensity_formula", "For the adjuvant period, relative dose intensity for cycle n is derived as the administered dose recorded at Cycle(n) divided by the administered dose recorded at Cycle(n-1)", {"derivation.dose_intensity_shape": "numerator Cycle(n) is 1 cycle(s) later than the denominator"}, "relative dose intensity is derived", {}),
    ("derivation.teae_definition", "For the overall period, a treatment-emergent adverse event is defined as an adverse event with onset on or after the first dose and before surgery.", {"definition.teae_shape": "GTE(FIRST_IP) + LTE(SURGERY)"}, "a treatment-emergent adverse event", {}),
    ("derivation.category_set_integrity", "reported using the categories >= 50, >= 40 and < 50, >= 40 and < 50.", {"definition.category_set_integrity": 'INCOMPLETE — the category ">= 40 and < 50" is listed twice; values below 40 have no category'}, "reported using the categories high, low.", {}),
    ("editorial.misspelling", "a seperate list", {"standard.spelling.separate": "seperate"}, "a separate list", {}),
    ("editorial.confusable_word", "in there pivotal studies", {"standard.wording.there_three": "there"}, "there is one study", {}),
]


@pytest.fixture(scope="module")
def hits(spark):
    """All cases in one run: a document for each text."""
    rows = []
    for i, (_rule, yes, _, no, options) in enumerate(CASES):
        rows += rows_of(yes, doc=f"{i}-yes", seq=2 * i, **options) + rows_of(no, doc=f"{i}-no", seq=2 * i + 1, **options)
    none = spark.createDataFrame([], ABBREVIATIONS), spark.createDataFrame([], SECTIONS)
    rows = RuleExtractor().extract(paragraphs(spark, rows), none[1], none[0]).collect()
    found = {}
    for r in rows:
        found.setdefault((r.documentId, r.extractorRule), {})[r.conceptKey] = r.normalizedValue
    return found


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(hits, i):
    rule, _, expected, _, _ = CASES[i]
    assert hits.get((f"{i}-yes", rule), {}) == expected
    assert (f"{i}-no", rule) not in hits


def test_all_rules_have_cases():
    contextual = {"terminology.acronym_definition", "crossref.reference_resolution", "crossref.numbered_title_reference", "crf_mapping.page_reference", "derivation.dataset_flow"}
    assert {c[0] for c in CASES} | contextual == set(BY_ID)
    assert len(RULES) == 45 and all(0.5 <= r.specificity <= 1 for r in RULES)


def test_contextual_rules(spark):
    sections = spark.createDataFrame([("D", 1, "1", "Introduction", 1, 1), ("D", 2, "APPENDIX 1", "Visit names", 2, 2), ("D", 3, "APPENDIX 2", "Handling of partial dates", 3, 3)], SECTIONS)
    abbreviations = spark.createDataFrame([("D", 1, "AEs", "Adverse events", "1.1-p1"), ("D", 2, "ATCC", "Anatomical Therapeutic Chemical class", "1.1-p1"), ("D", 3, "DM", "Demographics", "1.1-p1")], ABBREVIATIONS)
    rows = rows_of("See APPENDIX 1 for handling of partial dates. Refer to Section 9 for more. See APPENDIX 2.", "as in appendix 2: Visit names, and more", "The Adverse events page and the (DM) page.", doc="D")
    rows += rows_of("proc means data=adsl;\nset advs;", doc="D", kind="CODE", first=3) + rows_of("data one;\nset adsl;\nproc print data=one;", doc="E", kind="CODE", seq=1)
    rows = paragraphs(spark, rows)
    got = [(r.documentId, r.extractorRule, r.conceptKey, r.normalizedValue) for r in RuleExtractor().extract(rows, sections, abbreviations).orderBy("entitySeq").collect()]
    values = {(d, r): [v for dd, rr, _, v in got if (dd, rr) == (d, r)] for d, r, _, _ in got}
    assert values["D", "crossref.reference_resolution"] == [
        'MISMATCH — APPENDIX 1 is "Visit names", but "handling of partial dates" is APPENDIX 2 "Handling of partial dates"',
        "UNRESOLVED — 9 does not exist in this document",
        "RESOLVED",
    ]
    assert values["D", "crossref.numbered_title_reference"] == ['MISMATCH — APPENDIX 2 is "Handling of partial dates", but "Visit names" is APPENDIX 1 "Visit names"']
    assert values["D", "crf_mapping.page_reference"] == ["Adverse events", "(DM)"]
    assert values["D", "derivation.dataset_flow"] == ["2 UNRELATED INPUTS — adsl, advs"]
    assert values["E", "derivation.dataset_flow"] == ["SINGLE INPUT"]
    assert [(k, v) for _, r, k, v in got if r == "terminology.acronym_definition"] == [("acronym.AE", "adverse events"), ("acronym.ATCC", "anatomical therapeutic chemical class"), ("standard.acronym.anatomical_therapeutic_chemical", "ATCC"), ("acronym.DM", "demographics")]
