"""The catalogue's rules over paragraphs that the driver's tables give, with SQL that states the same.

Every part is a paragraph: a sentence of a protocol, plan or report with the part's own figures in
it. Which sentence it is follows from the part's key, so all rules see all parts, those that a
rule must leave alone too. The SQL states each rule by its own pattern, in DuckDB's dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.operators.catalogue import KEYWORDS, MISSPELLINGS
from veritab.plans.queries import query, t
from veritab.plans.scratch import stored

#: Figures of a part that sentences hold; both dialects read these expressions.
SLOTS = {
    "n": "p_size", "m": "p_partkey % 40 + 10", "s": "p_size + p_partkey % 40 + 10", "d": "p_size % 6", "c": "concat('1,', lpad(CAST(p_size AS STRING), 3, '0'))",
    "w": "CASE p_size % 6 WHEN 0 THEN 'one' WHEN 1 THEN 'four' WHEN 2 THEN 'Twelve' WHEN 3 THEN 'twenty' WHEN 4 THEN 'forty-two' ELSE CAST(p_size AS STRING) END",
}
#: (document type, kind, sentence)
SENTENCES = [
    ("SAP", "PROSE", "A total of {c} subjects will be randomised."),
    ("PROTOCOL", "PROSE", "The planned sample size is {m} and a total of {m} subjects will therefore be randomised."),
    ("SAP", "PROSE", "Randomised n = {n} n = {m} n = {s}"),
    ("SAP", "PROSE", "Randomised n = {n} n = {m}; a total of {c} subjects were screened."),
    ("SAP", "PROSE", "{m} subjects per treatment group are required, with {n} evaluable subjects per treatment group."),
    ("SAP", "PROSE", "a dropout rate of {n}.5 % is assumed, not a dropout of {n} %"),
    ("CSR", "PROSE", "A total of {m} subjects were randomised; {n} subjects received at least one dose."),
    ("CSR", "PROSE", "Randomised subjects by geographic region\nAsia {n} {m} {s}\nTotal {n} {m} {s}"),
    ("CSR", "PROSE", "Subjects by age\nTotal {n} {m} {s}"),
    ("CSR", "PROSE", "The Per-Protocol Set comprised {s} subjects, {n} in the test group and {m} in the other."),
    ("SAP", "PROSE", "A maintenance dose of {n} mg/kg every {m} days, at {n}-day intervals"),
    ("SAP", "PROSE", "In the phase 1 study a dose of {n}.50 mg/m2 administered once weekly"),
    ("SAP", "PROSE", "which was {n}.5 mg/kg administered twice daily."),
    ("SAP", "PROSE", "{w} subjects per treatment group provide {m}% power"),
    ("SAP", "PROSE", "The hypothesis is tested at a one-sided significance level of .0{m}, for {m} % power of pharmacokinetic equivalence"),
    ("SAP", "PROSE", "Tests for power are two-sided and conducted at a significance level of {n} %."),
    ("SAP", "PROSE", "It is done at a one-sided significance level of 0.05."),
    ("SAP", "PROSE", "all confidence intervals will be two-sided {m}% confidence intervals"),
    ("SAP", "PROSE", "For the FDA the two-sided {m}% confidence interval for the ratio lies within [0.{m}, 1.{m}]. The two-sided {n} % confidence interval for the difference is shown."),
    ("SAP", "PROSE", "An additional analysis: a one-sided {m}% confidence interval for the difference"),
    ("CSR", "PROSE", "The observed ratio of rates was 1.{m} with a two-sided {m}% confidence interval of 0.{m} to 1.{n}"),
    ("SAP", "PROSE", "The observed difference of rates was {n} % with a two-sided {m}% confidence interval of -{n} to {m}"),
    ("SAP", "PROSE", "The margin is derived as {n}% of the lower bound of the interval. The estimated effect is {m}% and the resulting margin is therefore {n}.5%."),
    ("SAP", "PROSE", "Safety data of {n} subjects are compared with Fisher's exact test and a t-test; others with the Wilcoxon rank-sum test."),
    ("SAP", "PROSE", "Efficacy of {n} subjects is compared with a chi-squared test."),
    ("SAP", "PROSE", "No statistical comparison between treatment groups will be performed for safety data ({n})."),
    ("PROTOCOL", "PROSE", "Inclusion: ECOG performance status of 0 or {d} on form AB-{n}"),
    ("CSR", "PROSE", "ECOG performance status is shown in categories (0, 1, {d})"),
    ("CSR", "PROSE", "ECOG performance status on the full scale from 0 up to {d} is shown"),
    ("SAP", "PROSE", "The pharmacokinetic set received at least {w} cycles and must complete all {n} neoadjuvant cycles"),
    ("SAP", "PROSE", "The safety set received at least {n} cycles"),
    ("SAP", "PROSE", "{w} subjects enrolled at {n} sites in Utopia are excluded from the Per-Protocol Set"),
    ("PROTOCOL", "PROSE", "creatinine clearance ≥ {m} mL/min and baseline left ventricular ejection fraction of at least {m} %, aged at least {w} years"),
    ("PROTOCOL", "PROSE", "creatinine clearance of at least {m} ml/min, creatinine clearance < {n} mL/min"),
    ("PROTOCOL", "PROSE", "Visits may shift ±{n} days or +/- {m} day, {m} days after the last dose, {n} day after the final dose, {n} days after the first"),
    ("PROTOCOL", "PROSE", "a neoadjuvant period of {w} cycles and an adjuvant period of {n} cycles, planned cycle interval of {m} days"),
    ("PROTOCOL", "PROSE", "An ECG is done at screening and on Cycle {n} Day {d}. Blood is drawn at surgery. LVEF at the end-of-treatment visit."),
    ("SAP", "PROSE", "An ECG is done at screening, visit {n}."),
    ("SAP", "PROSE", "graded by CTCAE v{n}.0 and by Common Terminology Criteria for Adverse Events version {m}, coded with MedDRA version {n}.10"),
    ("SAP", "PROSE", "the Full analysis Set, the full set, a Sensitivity Analysis {n} and pathologic complete response, the Safety set"),
    ("SAP", "CODE", "if trtgrp{n} then aval = trtgrpn;\n {m} \nelse dose_{n} = -{n}.5;\n-{n}.5"),
    ("SAP", "PROSE", "For the adjuvant period, relative dose intensity for cycle n is derived as the administered dose recorded at Cycle(n) divided by the administered dose recorded at Cycle(n - {n})."),
    ("SAP", "PROSE", "For the overall period, a treatment-emergent adverse event is defined as an adverse event with onset on or after the first dose of {n} mg and up to surgery and {n} days later."),
    ("SAP", "PROSE", "reported using the categories >= {m}, >= 5 and < {m}, < 5."),
    ("SAP", "PROSE", "reported using the categories >= {m}, >= 5 and < {m}, >= 5 and < {m}. Other categories have {n}."),
    ("SAP", "PROSE", "a seperate list of {n}, preformed after Adminstration by the Mostellar formula"),
    ("SAP", "PROSE", "in there pivotal studies; The SAF consist of {n} subjects, there is one study"),
]


def _spark_text(text: str):
    parts = re.split(r"\{(\w)\}", text)
    return F.concat(*[F.expr(f"CAST({SLOTS[x]} AS STRING)") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def _sql_text(text: str) -> str:
    parts = re.split(r"\{(\w)\}", text)
    lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return " || ".join(f"CAST({SLOTS[x]} AS VARCHAR)" if i % 2 else lit(x) for i, x in enumerate(parts))


def paragraphs(spark, sf) -> DataFrame:
    """Parts as paragraphs; documents are brands and types."""
    k = F.col("p_partkey") % len(SENTENCES)
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in SENTENCES]), (k + 1).cast("int"))
    text = None
    for i, (_, _, sentence) in enumerate(SENTENCES):
        text = F.when(k == i, _spark_text(sentence)) if text is None else text.when(k == i, _spark_text(sentence))
    part = t(spark, sf, "part").select("p_partkey", "p_size", "p_brand").withColumns({"text": text, "documentType": of(0), "kind": of(1)})
    return part.select(
        F.concat_ws(" ", "p_brand", "documentType").alias("documentId"), "documentType", F.lit("Title").alias("documentTitle"), F.lit("v1.0").alias("version"), F.lit("").alias("author"), F.lit("1").alias("sectionId"), F.lit("Text").alias("sectionHeading"),
        F.col("p_partkey").cast("string").alias("paragraphId"), F.lit(1).alias("printedPage"), F.lit(1).alias("pdfPage"), "text", F.split("text", "\n", -1).alias("lines"), "kind", F.lit(0).alias("docSeq"), F.lit(1).alias("sectionSeq"), F.col("p_partkey").cast("int").alias("paraSeq"))


def _sql_paragraphs() -> str:
    cases = lambda f: "CASE p_partkey % " + str(len(SENTENCES)) + "".join(f" WHEN {i} THEN {f(x)}" for i, x in enumerate(SENTENCES)) + " END"
    return f"p AS (SELECT CAST(p_partkey AS VARCHAR) AS part, {cases(lambda x: _sql_text(x[2]))} AS text, {cases(lambda x: repr(x[0]))} AS type, {cases(lambda x: repr(x[1]))} AS kind FROM part)"


WORDS = "['" + "','".join(S.SMALL_WORDS) + "']"
TENS = "['" + "','".join(S.TENS) + "']"


def num(e: str) -> str:
    """A number in digits or words, as DOUBLE."""
    first, second = f"split_part(lower({e}), '-', 1)", f"split_part(lower({e}), '-', 2)"
    return (f"coalesce(TRY_CAST(replace({e}, ',', '') AS DOUBLE), list_position({WORDS}, lower({e})) - 1e0, list_position({TENS}, lower({e})) * 1e1 + 1e1, "
            f"list_position({TENS}, {first}) * 1e1 + 1e1 + list_position({WORDS}, {second}) - 1e0)")  # fmt: skip


def txt(e: str) -> str:
    return f"(CASE WHEN {e} = floor({e}) THEN CAST(CAST({e} AS BIGINT) AS VARCHAR) ELSE CAST({e} AS VARCHAR) END)"


def n(k: int) -> str:
    return txt(num(f"g{k}"))


def tidy(e: str) -> str:
    return f"trim(regexp_replace(regexp_replace({e}, '\\s+', ' ', 'g'), '[.,;:]+$', ''))"


def sides(k: int) -> str:
    return f"lower(g{k}) || '-sided'"


ROOT = "CASE WHEN length(regexp_replace({b}, '[aeiou]', '', 'g')) >= 2 THEN regexp_replace({b}, '[aeiou]', '', 'g') ELSE {b} END"
BASE = "regexp_replace(regexp_replace(g0, '[0-9_]', '', 'g'), '(p?n)$', '')"
UNIT = "CASE lower(g2) WHEN 'mg/kg' THEN 'mg/kg' ELSE 'mg/m2' END"
REGIMEN = n(1) + f" || ' ' || {UNIT} || ' ' || CASE lower(g3) WHEN 'once weekly' THEN 'QW' WHEN 'once daily' THEN 'QD' WHEN 'twice daily' THEN 'BID' ELSE 'Q' || regexp_extract(g3, '[0-9]+') || 'D' END"
CI = n(2) + f" || '% CI (' || {sides(1)} || ')'"
COMPARATOR = "CASE WHEN lower(g1) IN ('≥', '>=', 'at least') THEN 'GTE' WHEN g1 IN ('≤', '<=') THEN 'LTE' ELSE g1 END"
STATISTIC = "'ciLevel=' || " + n(2) + " || "
#: What a category of a stated set of categories spans.
SPAN = "coalesce(regexp_extract(c, '>=\\s*([0-9.]+)', 1), '') || '..' || coalesce(regexp_extract(c, '<\\s*([0-9.]+)', 1), '')"
CATEGORIES = "list_transform(list_filter(list_transform(string_split(g1, ','), lambda x: trim(x)), lambda x: regexp_matches(x, '[0-9]')), lambda c: {0})".format(SPAN)
NAMES = "list_filter(list_transform(string_split(g1, ','), lambda x: trim(x)), lambda x: regexp_matches(x, '[0-9]'))"
LEAST = f"list_min(list_transform(list_filter({CATEGORIES}, lambda c: c NOT LIKE '..%'), lambda c: TRY_CAST(split_part(c, '..', 1) AS DOUBLE)))"
TWICE = f"list_distinct(list_filter({CATEGORIES}, lambda c: len(list_filter({CATEGORIES}, lambda o: o = c)) > 1))"
OPEN = f"len(list_filter({CATEGORIES}, lambda c: c LIKE '..%' AND TRY_CAST(split_part(c, '..', 2) AS DOUBLE) <= {LEAST})) > 0"
CLAUSE = "CASE WHEN regexp_matches(c, '(?i)on or after|after') THEN 'GTE' WHEN regexp_matches(c, '(?i)on or before|before|up to') THEN 'LTE' ELSE 'UNQUALIFIED' END || '(' || CASE WHEN regexp_matches(c, '(?i)surgery') THEN 'SURGERY' WHEN regexp_matches(c, '(?i)first administration|first dose') THEN 'FIRST_IP' ELSE 'OTHER' END || ')'"
STEP = "coalesce(TRY_CAST(regexp_extract({0}, 'n\\s*-\\s*([0-9]+)', 1) AS INTEGER), 0)"
DELTA = f"({STEP.format('g3')} - {STEP.format('g2')})"
SUMMED = r"(?m)^Total\s+([\d,]+)\s+([\d,]+)\s+([\d,]+)$"
AT = r"(?i)\b(?:at|on)\s+(screening|baseline|Cycle\s*\d+\s*Day\s*\d+|the end-of-treatment visit|end[-\s]of[-\s]treatment|surgery)"

#: (rule, pattern, groups, concept, value, attributes, condition, benign mode, raw text); what is None has its usual form.
RULES_SQL = [
    ("numeric.sample_size.planned", r"(?i)A total of ([\d,]+) subjects will (?:therefore )?be randomised", 1, "'sample_size.planned'", n(1), None, None, None, None),
    ("numeric.sample_size.planned", r"(?i)planned sample size (?:is|of) ([\d,]+)", 1, "'sample_size.planned'", n(1), None, None, None, None),
    ("numeric.sample_size.planned", r"(?i)Randomised\s+n\s*=\s*(\d+)\s+n\s*=\s*(\d+)\s+n\s*=\s*(\d+)", 3, "'sample_size.planned'", n(3), "'perArm=' || " + n(1), None, None, None),
    ("numeric.sample_size.planned_per_arm", r"(?i)([\d,]+) subjects per treatment group are required", 1, "'sample_size.planned_per_arm'", n(1), None, None, None, None),
    ("numeric.sample_size.evaluable", r"(?i)([\d,]+) evaluable subjects per treatment group", 1, "'sample_size.evaluable_per_arm'", n(1), None, None, None, None),
    ("numeric.dropout_rate", r"(?i)dropout rate of (\d+(?:\.\d+)?)\s*%", 1, "'design.dropout_rate'", n(1) + " || '%'", None, None, None, None),
    ("numeric.sample_size.randomised", r"(?i)A total of ([\d,]+) subjects were randomised", 1, "'sample_size.randomised'", n(1), None, None, None, None),
    ("numeric.sample_size.randomised", SUMMED, 3, "'sample_size.randomised'", n(3), "'armA=' || " + n(1) + " || ';armB=' || " + n(2), "regexp_matches(text, '(?i)randomised subjects by geographic region')", None, None),
    ("numeric.sample_size.treated", r"(?i)([\d,]+) subjects received at least one dose", 1, "'sample_size.treated'", n(1), None, None, None, None),
    ("numeric.sample_size.per_protocol", r"(?i)Per-Protocol Set comprised ([\d,]+) subjects,\s*([\d,]+) in the [^,]+ and ([\d,]+)", 3, "'sample_size.per_protocol'", n(1), "'armA=' || " + n(2) + " || ';armB=' || " + n(3), None, None, None),
    ("numeric.dose_regimen", r"(?i)(?:maintenance dose of|dose of|dose is) (-?\d+(?:\.\d+)?)\s*(mg/kg|mg/m2)(?:\s+administered)?\s+(once weekly|once daily|twice daily|every \d+ days)", 3, "'dose.regimen'", REGIMEN, None, None, "regexp_matches(text, '(?i)phase 1') ~ downgrade", None),
    ("numeric.dose_regimen", r"(?i)\bwas (-?\d+(?:\.\d+)?)\s*(mg/kg|mg/m2) administered (once weekly|once daily|twice daily)", 3, "'dose.regimen'", REGIMEN, None, None, None, None),
    ("numeric.sample_size.pk", r"(?i)([A-Za-z-]+|[\d,]+) subjects per treatment group provide (\d+)\s*% power", 2, "'sample_size.pk_per_arm'", n(1), None, None, None, None),
    ("statistical.alpha", r"(?i)(one|two)[-\s]sided significance level of (0?\.\d+)", 2, "'stat.alpha'", "'alpha ' || " + n(2) + f" || ' (' || {sides(1)} || ')'", None, "regexp_matches(text, '(?i)hypothes|tested|power|type I error')", None, None),
    ("statistical.alpha", r"(?i)(one|two)[-\s]sided significance level of (0?\.\d+)", 2, "'stat.alpha'", "'alpha ' || " + n(2) + f" || ' (' || {sides(1)} || ')'", None, "regexp_matches(text, '(?i)significance')", None, None),
    ("statistical.alpha", r"(?i)(one|two)[-\s]sided and conducted at a significance level of (\d+(?:\.\d+)?)\s*%", 2, "'stat.alpha'", "'alpha ' || " + txt(f"({num('g2')} / 100)") + f" || ' (' || {sides(1)} || ')'", None, None, None, None),
    ("statistical.power", r"(?i)(\d{2,3})\s*% power", 1, "'stat.power'", n(1) + " || '%'", None, None, "regexp_matches(text, '(?i)pharmacokinetic') ~ downgrade", None),
    ("statistical.default_ci_level", r"(?i)all confidence intervals will be (one|two)[-\s]sided (\d+)\s*% confidence intervals", 2, "'stat.default_ci_level'", CI, STATISTIC[:-4], None, None, None),
    ("statistical.equivalence_criterion", r"(?i)(one|two)[-\s]sided (\d+)\s*% confidence interval for the (difference|ratio)[^.]*?within \[\s*(-?[\d.]+)\s*%?\s*,\s*(-?[\d.]+)\s*%?\s*\]", 5, "'equivalence.ci_level.' || lower(g3)", CI,
     "'bounds=[' || " + n(4) + " || ', ' || " + n(5) + " || '];' || " + STATISTIC + "';lower=' || " + n(4) + " || CASE WHEN regexp_matches(text, '\\bFDA\\b') THEN ';regulator=FDA' ELSE '' END || ';statistic=' || upper(g3) || ';upper=' || " + n(5), None, None, None),
    ("statistical.ci_level_for_statistic", r"(?i)(one|two)[-\s]sided (\d+)\s*% confidence interval for the (difference|ratio)", 3, "'equivalence.ci_level.' || lower(g3)", CI, STATISTIC + "';statistic=' || upper(g3)", "NOT regexp_matches(text, '(?i)observed (ratio|difference)')", "regexp_matches(text, '(?i)additional analysis') ~ downgrade", None),
    ("statistical.observed_interval", r"(?i)observed (difference|ratio)[^.]*?was (-?\d+(?:\.\d+)?)\s*%? with a (?:one|two)[-\s]sided (\d+)\s*% confidence interval of (-?\d+(?:\.\d+)?) to (-?\d+(?:\.\d+)?)", 5, "'equivalence.observed.' || lower(g1)", "g2 || ' (' || g3 || '% CI ' || g4 || ' to ' || g5 || ')'",
     "'ciLevel=' || " + n(3) + " || ';estimate=' || " + n(2) + " || ';lower=' || " + n(4) + " || ';statistic=' || upper(g1) || ';upper=' || " + n(5), "type = 'CSR'", None, None),
    ("statistical.equivalence_margin_derivation", r"(?i)derived as (\d+)\s*% of the lower bound[^.]*?\.\s*The estimated effect is (-?\d+(?:\.\d+)?)\s*% and the resulting margin is therefore (-?\d+(?:\.\d+)?)\s*%", 3, "'design.equivalence_margin'", n(3) + " || '%'", "'base=' || " + n(2) + " || ';factor=' || " + txt(f"({num('g1')} / 100)") + " || ';stated=' || " + n(3), None, None, None),
    ("statistical.test_for_safety_data", r"(?i)(Fisher's exact test|chi-squared test|chi-square test|F-test|t-test|Wilcoxon(?: rank-sum)? test)", 1, "'practice.statistical_test_on_safety_data'", tidy("g0"), None, "regexp_matches(text, '(?i)Safety Set|safety data|demographic|baseline|anti-drug|ADA')", None, None),
    ("statistical.no_comparison_policy", r"(?i)No statistical comparisons? between treatment groups will be performed for (safety|efficacy) data", 1, "'policy.no_statistical_comparison.' || lower(g1)", "'STATED'", None, None, None, None),
    ("population.ecog_eligibility", r"(?i)ECOG[^.]{0,180}", 0, "'inclusion.ecog'", "'ECOG ' || CASE WHEN regexp_extract(g0, 'or ([0-9])', 1) = '0' THEN '0' ELSE '0-' || regexp_extract(g0, 'or ([0-9])', 1) END", None, "regexp_matches(text, '(?i)eligib|inclusion|enrol|permitted|criteri|study entry')", None, None),
    ("population.ecog_reporting_scale", r"(?i)ECOG performance status[^.]*?categories \(([^)]+)\)", 1, "'reporting.ecog_scale'", "'ECOG categories ' || g1", None, None, None, None),
    ("population.ecog_reporting_scale", r"(?i)ECOG performance status[^.]*?full scale from (\d)[a-z ]*?to (\d)\b", 2, "'reporting.ecog_scale'", "'ECOG categories ' || g1 || '-' || g2", None, None, None, None),
    ("population.pk_set_cycle_requirement", r"(?i)received at least ([a-z]+|\d+) cycles", 1, "'population.pk_set.cycle_requirement'", "'GTE ' || " + n(1) + " || ' cycles'", None, "regexp_matches(text, '(?i)pharmacokinetic')", None, None),
    ("population.pk_set_cycle_requirement", r"(?i)complete all ([a-z]+|\d+) (?:neoadjuvant )?cycles", 1, "'population.pk_set.cycle_requirement'", "'ALL ' || " + n(1) + " || ' cycles'", None, "regexp_matches(text, '(?i)pharmacokinetic')", None, None),
    ("population.pps_site_exclusion", r"(?i)([A-Za-z]+|\d+) subjects enrolled at ([a-z]+|\d+) sites? in ([A-Z][a-z]+)[^.]{0,80}?excluded from the Per-[Pp]rotocol [Ss]et", 3, "'population.pps_site_exclusion'", n(1) + " || ' subjects at ' || " + n(2) + " || ' sites in ' || g3", "'country=' || g3 || ';sites=' || " + n(2) + " || ';subjects=' || " + n(1), None, None, None),
    ("population.creatinine_clearance", r"(?i)creatinine clearance\s*(?:of\s+)?(>=|<=|≥|≤|at least)\s*(\d+)\s*(mL/min)", 3, "'inclusion.creatinine_clearance'", f"{COMPARATOR} || ' ' || " + n(2) + " || ' mL/min'", None, None, None, None),
    ("population.lvef_threshold", r"(?i)left ventricular ejection fraction of at least (\d+)\s*%", 1, "'inclusion.lvef_baseline'", "'GTE ' || " + n(1) + " || ' %'", None, "regexp_matches(text, '(?i)eligib|adequate cardiac function|baseline')", None, None),
    ("population.min_age", r"(?i)aged at least (\d+|[a-z]+) years", 1, "'inclusion.min_age'", "'GTE ' || " + n(1) + " || ' years'", None, None, None, None),
    ("schedule.visit_window", r"(?i)(?:\+/-|±)\s*(\d+)\s*(days?)", 2, "'schedule.visit_window'", "'+/-' || " + n(1) + " || ' days'", None, None, None, None),
    ("schedule.safety_followup", r"(?i)(\d+)\s*(days?) after the (?:last|final) dose", 2, "'safety.followup_window'", n(1) + " || ' days'", None, None, None, None),
    ("schedule.cycle_interval", r"(?i)(?:every (\d+) days)", 1, "'schedule.cycle_interval'", n(1) + " || ' days'", None, None, None, None),
    ("schedule.cycle_interval", r"(?i)at (\d+)-day intervals", 1, "'schedule.cycle_interval'", n(1) + " || ' days'", None, None, None, None),
    ("schedule.cycle_interval", r"(?i)planned cycle interval of (\d+) days", 1, "'schedule.cycle_interval'", n(1) + " || ' days'", None, None, None, None),
    ("schedule.neoadjuvant_cycles", r"(?i)(?:a )?(neoadjuvant|adjuvant) period of ([a-z]+|\d+) cycles", 2, "'schedule.cycles.' || lower(g1)", n(2) + " || ' cycles'", None, None, None, None),
    ("terminology.grading_scale", r"(?i)Common Terminology Criteria for Adverse Events version (\d+(?:\.\d+)?)", 1, "'safety.ae_grading_scale'", "'CTCAE ' || g1", None, None, None, None),
    ("terminology.grading_scale", r"(?i)\bCTCAE\b\)?\s*(?:v(?:ersion)?\.?\s*)(\d+(?:\.\d+)?)", 1, "'safety.ae_grading_scale'", "'CTCAE ' || g1", None, None, None, None),
    ("terminology.dictionary_version", r"(?i)MedDRA version (\d+(?:\.\d+)?)", 1, "'coding.meddra_version'", "'MedDRA ' || g1", None, None, None, None),
    *[("terminology.controlled_vocabulary", p, 0, f"'vocabulary.{slug}'", v, None, None, None, None) for slug, p, v in (
        ("full_analysis_set", r"\bFull [Aa]nalysis [Ss]et\b", "g0"), ("per_protocol_set", r"\bPer-[Pp]rotocol [Ss]et\b", "g0"), ("safety_set", r"\bSafety [Ss]et\b", "g0"), ("pharmacokinetic_set", r"\bPharmacokinetic [Ss]et\b", "g0"),
        ("pathological_complete_response", r"(?i)\bpatholog(?:ic|ical) (?:complete response|response categories)\b", "lower(g0)"), ("sensitivity_analysis", r"\b[Ss]ensitiv(?:e|ity) [Aa]nalysis\b", "lower(g0)"))],
    ("derivation.identifier_spelling", r"\b[a-z][a-z0-9_]{1,15}\b", 0, "'derivation.identifier.' || " + ROOT.format(b=BASE), "g0", None, f"kind = 'CODE' AND length(g0) >= 3 AND g0 NOT IN ({', '.join(repr(k) for k in KEYWORDS)})", None, None),
    ("derivation.stray_token", r"(?m)^ *(-?\d+(?:\.\d+)?) *$", 1, "'derivation.code_hygiene'", "'STRAY LITERAL \"' || g1 || '\"'", "'expected=NO STRAY LITERALS'", "kind = 'CODE'", None, "g1"),
    ("derivation.dose_intensity_formula", r"(?i)For the (neoadjuvant|adjuvant|overall)[^.]*?relative dose intensity for cycle n is derived as the administered dose recorded at Cycle\(([^)]+)\) divided by the administered dose recorded at Cycle\(([^)]+)\)", 3, "'derivation.dose_intensity_shape'",
     f"'numerator Cycle(' || trim(g2) || ') is ' || CASE WHEN {DELTA} > 0 THEN {DELTA} || ' cycle(s) later than' WHEN {DELTA} < 0 THEN (-{DELTA}) || ' cycle(s) earlier than' ELSE 'the same cycle as' END || ' the denominator'", "'period=' || lower(g1)", "kind = 'PROSE'", None, None),
    ("derivation.teae_definition", r"(?i)For the (neoadjuvant|adjuvant|overall) period, a treatment-emergent adverse event is defined as an adverse event with onset ([^.]+)\.", 2, "'definition.teae_shape'", f"array_to_string(list_transform(string_split_regex(g2, '(?i)\\s+and\\s+'), lambda c: {CLAUSE}), ' + ')", "'period=' || lower(g1)", "kind = 'PROSE'", None, None),
    ("derivation.category_set_integrity", r"(?i)using the categories ([^.]+)\.", 1, "'definition.category_set_integrity'",
     f"CASE WHEN len({TWICE}) = 0 AND {OPEN} THEN 'COMPLETE AND DISTINCT' ELSE 'INCOMPLETE — ' || array_to_string(list_concat(list_transform({TWICE}, lambda x: 'the category \"' || {NAMES}[list_position({CATEGORIES}, x)] || '\" is listed twice'), CASE WHEN {OPEN} THEN [] ELSE ['values below ' || {txt(LEAST)} || ' have no category'] END), '; ') END", "'expected=COMPLETE AND DISTINCT'", "kind = 'PROSE'", None, None),
    *[("editorial.misspelling", p.replace(S.WB, r"\b"), 0, f"'standard.spelling.{slug}'", "g0", "'expected=" + right + (";note=" + note if note else "") + "'", None, None, None) for p, right, slug, note in MISSPELLINGS],
    ("editorial.confusable_word", r"(?i)\b(there) [a-z]+ (?:studies|trials|cycles|subjects|analyses)\b", 1, "'standard.wording.there_three'", "g1", "'expected=three'", None, None, "g1"),
    ("editorial.confusable_word", r"\b(?:SAF|FAS|PPS|PKS|[A-Z][a-z]+ Set) consist of\b", 0, "'standard.wording.subject_verb_agreement'", "g0", "'expected=consists of'", None, None, None),
]


def _sql() -> str:
    parts = []
    for ord_, (rule, rx, groups, key, value, attributes, when, benign, raw) in enumerate(RULES_SQL):
        rx = rx.replace("'", "''")
        taken = ", ".join(f"regexp_extract_all(text, '{rx}', {k})[i] AS g{k}" for k in range(groups + 1))
        condition, _, mode = (benign or "").partition(" ~ ")
        parts.append(
            f"SELECT part, '{rule}' AS rule, {key} AS key, {value} AS value, {attributes or chr(39) * 2} AS attributes, {f'CASE WHEN {condition} THEN {mode!r} END' if benign else 'NULL'} AS benign, {raw or tidy('left(g0, 130)' if 'ecog_elig' in rule else 'g0')} AS raw, {ord_} AS o, i "
            f"FROM (SELECT *, {taken} FROM (SELECT *, unnest(range(1, len(regexp_extract_all(text, '{rx}')) + 1)) AS i FROM p)) WHERE {when or 'true'}")  # fmt: skip
    due = (f"SELECT part, 'coverage.assessment_timepoint' AS rule, 'assessment.' || a || '.' || CASE WHEN regexp_matches(m, '(?i)cycle') THEN 'c' || regexp_extract(m, '(?i)Cycle\\s*([0-9]+)', 1) || 'd' || regexp_extract(m, '(?i)Day\\s*([0-9]+)', 1) WHEN regexp_matches(m, '(?i)end.of.treatment') THEN 'eot' ELSE lower(m) END AS key, 'REQUIRED' AS value, '' AS attributes, NULL AS benign, "
           f"CASE a WHEN 'ecg' THEN 'twelve-lead electrocardiogram ' ELSE 'left ventricular ejection fraction ' END || r AS raw, 999 AS o, i FROM (SELECT *, regexp_extract_all(s, '{AT}', 1)[i] AS m, regexp_extract_all(s, '{AT}')[i] AS r FROM (SELECT *, unnest(range(1, len(regexp_extract_all(s, '{AT}')) + 1)) AS i FROM (SELECT part, type, unnest(string_split(text, '.')) AS s FROM p), "
           f"(VALUES ('lvef', '(?i)echocardiogram|left ventricular ejection fraction|\\bLVEF\\b'), ('ecg', '(?i)electrocardiogram|\\bECG\\b')) v(a, pattern) WHERE regexp_matches(s, pattern) AND type IN ('PROTOCOL', 'CRF')))")  # fmt: skip
    return f"""WITH {_sql_paragraphs()}, hits AS ({' UNION ALL '.join([*parts, due])})
SELECT part, rule, key AS "conceptKey", value, attributes, benign, raw FROM hits WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY part, key, value ORDER BY o, i) = 1"""


def shown(facts: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return facts.select(F.col("citation.paragraphId").alias("part"), F.col("extractorRule").alias("rule"), "conceptKey", F.col("normalizedValue").alias("value"), F.coalesce(listed, F.lit("")).alias("attributes"), F.col("benign.mode").alias("benign"), F.col("rawText").alias("raw"))


@query(_sql())
def extraction_rules(spark, sf):
    """The 40 rules that look at one paragraph, over all parts as paragraphs."""
    from veritab.operators.catalogue import CONTEXTUAL, RULES
    from veritab.plans.queries import no_context
    from veritab.plans.run import RuleExtractor

    return shown(RuleExtractor([r for r in RULES if r.id not in CONTEXTUAL]).extract(paragraphs(spark, sf), *no_context(spark)))


def pages_of_parts(spark, sf):
    """Parts as pages of documents: (items, descriptors). Ten parts a page, a paragraph each, below a heading, above a footer."""
    own = paragraphs(spark, sf).select("documentId", "documentType", "paraSeq", "lines", "kind")
    place = F.row_number().over(Window.partitionBy("documentId").orderBy("paraSeq")) - 1  # a document has some of the parts of a brand
    own = stored([own.withColumns({"at": place % 10, "pdfPage": F.floor(place / 10).cast("int") + 2})], "parts")  # items are read more than once

    def item(seq, text, y, size, font) -> list:
        return ["documentId", "pdfPage", seq.cast("int").alias("itemSeq"), text.alias("text"), F.lit(68.0).alias("x"), y.cast("double").alias("y"), (F.length(text) * 4.5).alias("width"), F.lit(size).alias("height"), F.lit(0).alias("rotation"), font.alias("fontFamily")]

    lines = own.select("*", F.posexplode("lines").alias("k", "line"))
    body = lines.select(*item(F.col("paraSeq") * 100 + F.col("k"), F.col("line"), 740 - 66 * F.col("at") - 11 * F.col("k"), 9.5, F.when(F.col("kind") == "CODE", "Courier").otherwise("Times")))
    page = own.select("documentId", "pdfPage").distinct()
    head = page.select(*item(F.lit(0), F.concat((F.col("pdfPage") - 1).cast("string"), F.lit(" Part ").cast("string"), F.col("pdfPage").cast("string")), F.lit(770), 10.5, F.lit("Times")))
    foot = page.select(*item(F.lit(1), F.concat(F.lit("Page "), (F.col("pdfPage") - 1).cast("string"), F.lit(" of 90")), F.lit(52), 7.5, F.lit("Times")))
    names = own.select("documentId", "documentType").distinct()
    descriptors = names.select(F.col("documentId").alias("id"), F.col("documentType").alias("type"), F.concat("documentId", F.lit(".pdf")).alias("fileName"), F.col("documentId").alias("title"), F.lit("v1.0").alias("version"), F.lit("").alias("effectiveDate"), F.lit("").alias("author"), (F.row_number().over(Window.orderBy("documentId")) - 1).cast("int").alias("docSeq"))  # a row a document
    return body.unionByName(head).unionByName(foot), descriptors


@query()
def full_run(spark, sf):
    """All parts as pages, from positioned items to findings. SQL states its steps one by one, in the other queries."""
    from veritab.plans.run import run_pipeline

    return run_pipeline(*pages_of_parts(spark, sf)).findings.select("id", "conceptKey", "severity", "confidence", "scope", "title")
