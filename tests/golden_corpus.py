"""Four documents with planted defects, decoys and true negatives, laid out by Spark."""

from veritab.model import DESCRIPTORS
from veritab.sources import filling

FILLER = [f"The course of period {i} is set out for the sites, whose staff keep the records in the files of the trial." for i in range(40)]
#: 34 acronyms that plan and report spell out differently, and as many that they share.
ACRONYMS = [f"{a}{b}Q" for a in "BCDFGHJKLMNPRSTVWX" for b in "ZY"][:34]
FIRST, SECOND = "alder birch cedar", "maple larch aspen"


def listed(other):
    return tuple(f"{x} {(SECOND if other else FIRST)} of {x.lower()}" for x in ACRONYMS) + tuple(f"{x}W shared words of {x.lower()}" for x in ACRONYMS)


DOCUMENTS = {
    "T": ("PROTOCOL", [
        ("1 Design", ["28 days after the final dose is the last visit.", "A baseline ECG is done at screening and at surgery.", "Subjects are aged at least eighteen years.", "Results are coded with MedDRA version 18.1.", "A neoadjuvant period of eight cycles is planned.", "Inclusion asks for creatinine clearance ≥ 60 mL/min.", "Entry needs a baseline left ventricular ejection fraction of at least 55 %.", "All tests have a one-sided significance level of 0.025."]),
        ("2 Conduct", FILLER[:20]),
    ]),
    "P": ("SAP", [
        ("1 Size", ["279 evaluable subjects per treatment group. With a dropout rate of 10 % this means that 310 subjects per treatment group are required.", "A total of 620 subjects will be randomised.", "The sample gives 90% power."]),
        ("2 Methods", ["The margin is derived as 50% of the lower bound of the interval. The estimated effect is 26% and the resulting margin is therefore 15%.", "Visits may shift ±3 days. Other visits may shift ±7 days.", "The confirmatory dose of 6 mg/kg every 21 days.", "No statistical comparison between treatment groups will be performed for safety data. Safety data are compared with Fisher's exact test.", "The two-sided 90% confidence interval for the ratio lies within [0.80, 1.25]. The two-sided 95% confidence interval for the difference lies within [-10, 10].", "A seperate list is kept. The planned cycle interval of 21 days holds; the planned dose is 6 mg/kg, giving 0.29 a day.", "Details are in Section 1 and in Section 9.9."]),
        ("3 ABBREVIATIONS", list(listed(False))),
        ("4 Rules", FILLER[20:]),
    ]),
    "R": ("CSR", [
        ("1 Subjects", ["A total of 655 subjects were randomised.", "30 days after the last dose. In the phase 1 study a dose of 8 mg/kg every 21 days was given.", "Subjects were aged at least twenty years.", "Results were coded with MedDRA version 19.0.", "A neoadjuvant period of six cycles was given.", "Inclusion asked for creatinine clearance ≥ 50 mL/min.", "Entry needed a baseline left ventricular ejection fraction of at least 50 %.", "Tests had a one-sided significance level of 0.025.", "The pharmacokinetic analysis has 80% power."]),
        ("2 Results", ["The observed ratio of rates was 1.02 with a two-sided 90% confidence interval of 0.91 to 1.14. The observed difference of rates was 4 with a two-sided 95% confidence interval of -3 to 12.", "An additional analysis shows a two-sided 90% confidence interval for the difference.", "Randomised subjects by geographic region Asia 100 110 210 Europe 210 235 445 Total 310 345 655"]),
        ("3 ABBREVIATIONS", list(listed(True))),
        ("4 Notes", FILLER[:30]),
    ]),
    "C": ("CRF", [("1 Forms", ["The ECG form is filled in at screening.", "28 days after the last dose the visit is noted."]), ("2 Fields", FILLER[5:25])]),
}


def corpus(spark):
    """items, descriptors and page_map."""
    heads = [(d, kind, f"{d.lower()}.pdf", f"Document {d}", "v1.0", "", "A. Author", i, f"Study header {d}", 1 + i % 2) for i, (d, (kind, _)) in enumerate(DOCUMENTS.items())]
    rows = []
    for d, (_, sections) in DOCUMENTS.items():
        blocks = []
        for heading, texts in sections:
            blocks.append(("heading", heading, None))
            blocks += [("table", None, texts)] if "ABBREVIATIONS" in heading else [("para", x, None) for x in texts]
        rows += [(d, k, *b) for k, b in enumerate(blocks)]
    return filling.corpus(spark.createDataFrame(heads, f"{DESCRIPTORS}, docSeq int, header string, leaves int"), spark.createDataFrame(rows, filling.BLOCKS))


MANIFEST = "id string, summary string, kind string, severity string, conceptKey string, scope string, evidence string, arithmetic string, resolvedCrossReferences int"
CROSS, WITHIN = "CROSS_DOCUMENT", "INTRA_DOCUMENT"
#: (severity, concept, scope, what the finding says): severities follow from the fixed table by concept and category.
DEFECTS = [
    ("CRITICAL", "equivalence.criteria_verdict", CROSS, "difference not met, ratio met"),
    ("CRITICAL", "sample_size.planned~sample_size.randomised", CROSS, "620 planned, 655 reported"),
    ("MAJOR", "safety.followup_window", CROSS, "28 days / 30 days"),
    ("MAJOR", "crossref.integrity", WITHIN, "Section 9.9"),
    ("MAJOR", "coding.meddra_version", CROSS, "19.0"),
    ("MAJOR", "inclusion.creatinine_clearance", CROSS, "≥ 50 mL/min"),
    ("MAJOR", "inclusion.min_age", CROSS, "twenty years"),
    ("MAJOR", "inclusion.lvef_baseline", CROSS, "55"),
    ("MAJOR", "schedule.cycles.neoadjuvant", CROSS, "6 cycles"),
    ("MAJOR", "assessment.ecg.surgery", CROSS, None),
    ("MAJOR", "policy.safety_testing_contradiction", WITHIN, "Fisher's exact test"),
    ("MINOR", "design.equivalence_margin", None, "13.00%"),
    ("MINOR", "standard.spelling.separate", None, "seperate"),
    ("MINOR", "schedule.visit_window", WITHIN, "+/-3 days / +/-7 days"),
    *[("MAJOR", f"acronym.{x}", CROSS, f"larch aspen of {x.lower()}") for x in ACRONYMS],
]
DECOYS = [("dose.regimen", "8 mg/kg"), ("equivalence.ci_level.difference", "90% CI"), ("stat.power", "80%")]
NEGATIVES = ["inflated for dropouts", "doubled give the total", "Planned dose intensity"]


def manifest():
    """48 defects, 3 decoys and 4 true negatives."""
    rows = [(f"A{i}", "", "FINDING", severity, concept, scope, evidence, None, None) for i, (severity, concept, scope, evidence) in enumerate(DEFECTS)]
    rows += [(f"C{i}", "", "DECOY", "MINOR", concept, CROSS, evidence, None, None) for i, (concept, evidence) in enumerate(DECOYS)]
    rows += [(f"D{i}", "", "TRUE_NEGATIVE", None, None, None, None, label, None) for i, label in enumerate(NEGATIVES)]
    return [*rows, ("D9", "", "TRUE_NEGATIVE", None, None, None, None, None, 1)]
