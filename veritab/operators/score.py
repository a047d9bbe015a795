"""Severity by three lookups, and confidence as a sum of explained factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.scalars import clamp, fixed, half_up

#: Severities of concepts, of concept prefixes in order, and of categories.
BY_CONCEPT = {
    "CRITICAL": [
        "sample_size.planned", "sample_size.planned_per_arm", "sample_size.randomised", "sample_size.treated", "sample_size.per_protocol",
        "sample_size.evaluable_per_arm", "stat.alpha", "equivalence.ci_level.ratio", "equivalence.ci_level.difference", "definition.teae_shape",
        "dose.regimen",
    ],
    "MAJOR": [
        "stat.power", "stat.default_ci_level", "design.dropout_rate", "inclusion.ecog", "inclusion.creatinine_clearance", "inclusion.lvef_baseline",
        "inclusion.min_age", "reporting.ecog_scale", "population.pk_set.cycle_requirement", "population.pps_site_exclusion", "safety.followup_window",
        "safety.ae_grading_scale", "coding.meddra_version", "schedule.cycle_interval", "definition.category_set_integrity",
        "derivation.dose_intensity_shape", "derivation.dataset_consistency", "practice.statistical_test_on_safety_data",
    ],
    "MINOR": [
        "design.equivalence_margin", "schedule.visit_window", "derivation.code_hygiene",
    ],
}
BY_PREFIX = [
    ("derivation.identifier.", "CRITICAL"), ("acronym.", "MAJOR"), ("standard.acronym.", "MAJOR"), ("crossref.", "MAJOR"),
    ("assessment.", "MAJOR"), ("vocabulary.", "MINOR"), ("standard.spelling.", "MINOR"), ("standard.wording.", "MINOR"),
]
BY_CATEGORY = {
    "NUMERIC": "CRITICAL", "STATISTICAL": "CRITICAL", "ENDPOINT": "CRITICAL", "POPULATION": "MAJOR", "SCHEDULE": "MAJOR", "CROSSREF": "MAJOR", "CRF_MAPPING": "MAJOR",
    "DERIVATION": "MAJOR", "COVERAGE": "MAJOR", "TERMINOLOGY": "MINOR", "EDITORIAL": "MINOR",
}
#: Baselines by kind of finding, weights, and how benign context lowers a score.
BASE = {"VALUE_MISMATCH": 0.30, "EXPECTED_VALUE": 0.38, "COVERAGE_GAP": 0.30, "RELATED_PAIR": 0.32, "CLUSTER": 0.28, "ARITHMETIC": 0.45}
SPECIFICITY, CONTEXT, CORROBORATION, BREADTH = 0.30, 0.15, 0.15, 0.10
DOWNGRADE, CEILING, MITIGATE = 0.25, 0.30, 0.7
REVIEW_THRESHOLD = 0.50

BASE_DETAIL = {
    "VALUE_MISMATCH": "Sources state different values for one concept.",
    "EXPECTED_VALUE": "A stated value departs from a standard or from the document's own structure.",
    "COVERAGE_GAP": "What one document requires has no counterpart in the document that has to carry it out.",
    "RELATED_PAIR": "Two concepts that belong together hold values that a declared check rejects.",
    "CLUSTER": "Several names were found to mean one thing.",
    "ARITHMETIC": "A stated derivation gives another result when it is done again.",
}


def lookup(key: Column, prefixes: list[tuple[str, str]], exact: dict[str, list[str]], default: Column) -> Column:
    """The exact key's value, else that of the first prefix, else default."""
    out = default
    for prefix, value in reversed(prefixes):
        out = F.when(key.startswith(prefix), value).otherwise(out)
    of = {}
    for value, keys in exact.items():
        for k in keys:
            of[k] = value
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), key), out) if of else out


def severity(concept: Column, category: Column, downgraded: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BY_CATEGORY.items() for x in kv])
    return F.when(downgraded, "MINOR").otherwise(lookup(concept, BY_PREFIX, BY_CONCEPT, F.try_element_at(table, category)))


def confidence(kind: Column, specificity: Column, rules: Column, context: Column, support: Column, types: Column, benign: Column) -> Column:
    """struct(score, factors): factors are rounded one by one, the baseline is not; the sum is lowered, rounded and clamped in this order."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), kind)
    detail = F.try_element_at(F.create_map(*[F.lit(x) for kv in BASE_DETAIL.items() for x in kv]), kind)
    parts = [
        ("Baseline", base, detail),
        ("Rule specificity", half_up(SPECIFICITY * specificity), F.concat(F.lit("Mean specificity "), fixed(specificity, 2), F.lit(" over rules: "), F.array_join(rules, ", "))),
        ("Context confirmation", half_up(CONTEXT * context), F.concat(F.floor(context * 100 + 0.5).cast("string"), F.lit("% of the occurrences stand in the context that the rule asks for."))),
        ("Cross-document corroboration", F.when(support >= 2, CORROBORATION).otherwise(0.0), F.concat(F.lit("Best support of one value: "), support.cast("string"), F.lit(" document type(s)."))),
        ("Breadth of evidence", F.when(types >= 3, BREADTH).otherwise(0.0), F.concat(types.cast("string"), F.lit(" document type(s) give evidence."))),
    ]
    total = sum((p[1] for p in parts[1:]), parts[0][1])
    lowered = F.when(benign == "downgrade", F.least(total * DOWNGRADE, F.lit(CEILING))).when(benign == "mitigate", total * MITIGATE).otherwise(total)
    factor = lambda label, value, text: F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), value.alias("contribution"), text.alias("detail"))
    listed = F.array(*[factor(*p) for p in parts])
    extra = F.when(benign != "none", F.array(factor(F.when(benign == "downgrade", "Known-benign pattern").otherwise("Mitigating context"), half_up(lowered - total), F.lit("Context may explain the difference; a reviewer decides."))))
    return F.struct(clamp(half_up(lowered), 0.05, 0.95).alias("score"), F.when(benign != "none", F.concat(listed, F.coalesce(extra, F.filter(listed, lambda _: F.lit(False))))).otherwise(listed).alias("factors"))
