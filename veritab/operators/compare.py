"""Findings from facts. Every check lists its evidence; one shared aggregation makes findings of it.

Evidence is a row for each fact that a finding rests on, with the finding's key; where facts are many to
each finding, a row stands for several (times). Scores need only sums over evidence, so they are
pre-aggregated; only occurrences (one for each document, value and section) are gathered into a finding,
and only where they are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.model import DOCUMENT_TYPES, SEVERITIES, position
from veritab.operators import profiles, relational, score
from veritab.plans.scratch import stored

@dataclass(frozen=True)
class Coverage:
    """Concepts (by their beginning) that one document type states and another must have; describe tells of one that has not."""

    prefix: str
    stated: str
    expected: str

    def describe(self) -> Column:
        return F.concat(F.lit(f"{self.stated} "), F.col("citation.version"), F.lit(' states "'), F.col("rawText"), F.lit(f'"; {self.expected} has no counterpart.'))


#: What one document requires of another.
COVERAGE = (Coverage("assessment.", "PROTOCOL", "CRF"), Coverage("population.pps_site_exclusion", "SAP", "PROTOCOL"))
#: Share of drift below which more subjects than planned are normal.
DRIFT = 0.02
SIMILAR = 0.5

_E = ["entitySeq", "id", "rawText", "normalizedValue", "citation", "extractorRule", "ruleSpecificity", "contextConfirmed", "documentId", "documentType"]
_HEAD = ["draft", "kind", "conceptKey", "category", "severityKey", "fixedSeverity", "fixedScope", "benign", "note", "title", "description"]


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def evidence(df: DataFrame, draft: Column, kind: str, concept: Column, category: Column, *, severity_key: Column | None = None, severity: Column | None = None, scope: Column | None = None, benign: Column | None = None, note: Column | None = None, title: Column | None = None, description: Column | None = None, types: Column | None = None, times: Column | None = None) -> DataFrame:
    return df.select(
        draft.alias("draft"), F.lit(kind).alias("kind"), concept.alias("conceptKey"), category.alias("category"), (concept if severity_key is None else severity_key).alias("severityKey"),
        (_null() if severity is None else severity).alias("fixedSeverity"), (_null() if scope is None else scope).alias("fixedScope"), (F.lit("none") if benign is None else benign).alias("benign"),
        (_null() if note is None else note).alias("note"), (_null() if title is None else title).alias("title"), (_null() if description is None else description).alias("description"),
        (_null("array<string>") if types is None else types).alias("fixedTypes"), *[F.col(c) for c in _E], (F.lit(1) if times is None else times).cast("long").alias("times"),
    )


def _mode() -> Column:
    return F.col("benign.mode")


def value_evidence(facts: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """Disagreement within a document, and between the values that documents settle on. left_out: concepts (conceptKey) that are not compared.

    What is decided rests on counts of each document's values, so facts themselves are shuffled once, to meet
    what was decided of their concept and document.
    """
    key = ["conceptKey", "documentId"]
    down, mitigated = (F.coalesce(_mode() == m, F.lit(False)) for m in ("downgrade", "mitigate"))
    said = facts.groupBy(*key, F.col("normalizedValue").alias("v")).agg(F.count_if(~down).alias("c"), F.min(F.when(~down, F.col("entitySeq"))).alias("s"), F.count("*").alias("ca"), F.min("entitySeq").alias("sa"), F.bool_or(down).alias("d"), F.bool_or(mitigated).alias("m"))
    own, place = F.struct("v", (F.col("c") > 0).alias("rest"), "d", "m"), lambda c, s: F.struct(F.col(c).alias("c"), (-F.col(s)).alias("s"))
    each = said.groupBy(*key).agg(F.max_by(own, F.when(F.col("c") > 0, place("c", "s"))).alias("_b"), F.max_by(own, place("ca", "sa")).alias("_all"), F.count("v").alias("_n"), F.bool_or("d").alias("d"), F.count(F.when(F.col("c") > 0, F.col("v"))).alias("_r"), F.bool_or("m").alias("m"))
    benign = lambda d, rest, m: F.when(F.col(d) & (F.col(rest) < 2), "downgrade").when(F.col(m), "mitigate").otherwise("none")
    each = each.select(*key, F.when(F.col("_b.v").isNotNull(), F.col("_b")).otherwise(F.col("_all")).alias("_s"), F.when(F.col("_n") >= 2, benign("d", "_r", "m")).alias("_within"))
    if left_out is not None:
        each = each.join(left_out, "conceptKey", "left_anti")
    each = stored([each], "settled")
    several = each.where("_s.v IS NOT NULL").groupBy("conceptKey").agg(F.count("*").alias("_d"), F.count_distinct("_s.v").alias("_v"), F.bool_or("_s.d").alias("d"), F.count_distinct(F.when(F.col("_s.rest"), F.col("_s.v"))).alias("_r"), F.bool_or("_s.m").alias("m"))
    several = several.where("_d >= 2 AND _v >= 2").select("conceptKey", benign("d", "_r", "m").alias("_across"))
    decided = each.join(several, "conceptKey", "left").select(*key, "_within", F.when(F.col("_across").isNotNull(), F.col("_s.v")).alias("_settled"), "_across").where("_within IS NOT NULL OR _settled IS NOT NULL")
    part = lambda kind, names, scope, mode: F.struct(F.concat_ws("|", F.lit(kind), *names).alias("draft"), F.lit(scope).alias("scope"), F.col(mode).alias("benign"))
    parts = F.array(F.when(F.col("_within").isNotNull(), part("intra", key, "INTRA_DOCUMENT", "_within")), F.when(F.col("normalizedValue") == F.col("_settled"), part("cross", key[:1], "CROSS_DOCUMENT", "_across")))
    rows = facts.join(decided, key).withColumn("_f", F.explode(F.filter(parts, lambda x: x.isNotNull())))
    return evidence(rows, F.col("_f.draft"), "VALUE_MISMATCH", F.col("conceptKey"), F.col("category"), scope=F.col("_f.scope"), benign=F.col("_f.benign"), note=F.when(_mode() == F.col("_f.benign"), F.col("benign.note")))


def expected_evidence(facts: DataFrame) -> DataFrame:
    """Values that differ from the one their fact expects; one finding for each wrong value."""
    expected = F.coalesce(F.try_element_at("attributes", F.lit("expected")), F.lit(""))
    wrong = facts.where(F.col("normalizedValue") != expected).withColumn("_draft", F.concat_ws("|", F.lit("expected"), "conceptKey", "normalizedValue"))
    modes = relational.benign_mode(wrong, ["_draft"], "normalizedValue", _mode()).withColumnRenamed("benign", "_benign")
    extra = F.coalesce(F.concat(F.lit(" "), F.try_element_at("attributes", F.lit("note"))), F.lit(""))
    return evidence(
        wrong.join(modes, "_draft"), F.col("_draft"), "EXPECTED_VALUE", F.col("conceptKey"), F.col("category"), benign=F.col("_benign"), severity=score.severity(F.col("conceptKey"), F.col("category"), F.lit(False)),
        title=F.concat(profiles.label(F.col("conceptKey"), F.col("category")), F.lit(" — "), S.shorten(F.col("normalizedValue"))),
        description=F.concat(F.col("documentType"), F.lit(" "), F.col("citation.version"), F.lit(' states "'), F.col("normalizedValue"), F.lit('"; expected is "'), expected, F.lit('".'), extra),
    )


def page_evidence(facts: DataFrame) -> DataFrame:
    """Names of pages that cluster together but are written in several ways."""
    named = facts.where("conceptKey = 'crf_page.reference'").withColumn("_t", F.filter(F.split(F.coalesce(F.try_element_at("attributes", F.lit("tokens")), F.lit("")), r"\|"), lambda t: t != ""))
    # The similarity of two names depends on the order in which they are seen: pairs keep it.
    edges = relational.similar_pairs(named, "entitySeq", "_t", SIMILAR)
    if not edges.take(1):
        return evidence(named.limit(0), _null(), "CLUSTER", _null(), _null())
    roots = relational.components(edges)
    rows = named.join(roots, named.entitySeq == roots.node)
    stats = rows.groupBy("root").agg(F.count_distinct("normalizedValue").alias("_n"), F.min_by("normalizedValue", "entitySeq").alias("_first"), F.collect_set(F.regexp_replace("normalizedValue", r"\([^)]*\)", "")).alias("_bare")).where("_n >= 2")
    rows = rows.join(stats, "root")
    slug = F.coalesce(F.nullif(F.array_join(S.content_tokens(F.col("_first")), "_"), F.lit("")), F.lit("reference"))
    minor = F.when(S.only_case_or_punctuation(F.col("_bare")), "MINOR").otherwise("MAJOR")
    return evidence(rows, F.concat_ws("|", F.lit("pages"), F.col("root").cast("string")), "CLUSTER", F.concat(F.lit("crf_page."), slug), F.lit("CRF_MAPPING"), severity=minor, title=F.lit("names"), description=F.concat(F.col("_n").cast("string"), F.lit(" names for what is taken to be one page.")))


def coverage_evidence(facts: DataFrame, documents: DataFrame, rows: Sequence[Coverage] = COVERAGE) -> DataFrame:
    """Facts of one document type without a counterpart in the type that must have one."""
    out, types = None, documents.select(F.collect_set("documentType").alias("t"))
    for c in rows:
        prefix, stated, expected = c.prefix, c.stated, c.expected
        own = facts.where(F.col("conceptKey").startswith(prefix))
        source = relational.uncovered(own.where(F.col("documentType") == stated), own.where(F.col("documentType") == expected), ["conceptKey"])
        source = source.crossJoin(F.broadcast(types.where(F.array_contains("t", stated) & F.array_contains("t", expected)).select(F.lit(1).alias("_both"))))  # one row or none
        part = evidence(source, F.concat_ws("|", F.lit("coverage"), F.lit(stated), "conceptKey"), "COVERAGE_GAP", F.col("conceptKey"), F.lit("COVERAGE"), scope=F.lit("CROSS_DOCUMENT"), severity=score.severity(F.col("conceptKey"), F.lit("COVERAGE"), F.lit(False)),
                        title=F.concat(profiles.label(F.col("conceptKey"), F.lit("COVERAGE")), F.lit(f" — required by {stated}, absent from {expected}")),
                        description=c.describe(), types=F.array(F.lit(stated), F.lit(expected)))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass(frozen=True)
class RelatedPair:
    """Two concepts whose settled values (l, r: columns of text) are judged together, over all documents or in each.

    evaluate says whether they are a finding; benign (none, mitigate or downgrade), note, title and
    description tell of it.
    """

    left: str
    right: str
    same_document: bool
    evaluate: Callable[[Column, Column], Column]
    title: Callable[[Column, Column], Column]
    description: Callable[[Column, Column], Column]
    benign: Callable[[Column, Column], Column] = lambda _l, _r: F.lit("none")
    note: Callable[[Column, Column], Column] = lambda _l, _r: F.lit(None).cast("string")
    category: str = "NUMERIC"


def _drift(planned: Column, actual: Column) -> Column:
    return F.abs(actual.try_cast("double") - planned.try_cast("double")) / F.nullif(planned.try_cast("double"), F.lit(0.0))


def _percent(l: Column, r: Column) -> Column:
    return S.fixed(_drift(l, r) * 100, 1)


PAIRS = (
    RelatedPair(
        "sample_size.planned", "sample_size.randomised", False, lambda l, r: _drift(l, r).isNotNull(),
        title=lambda l, r: F.concat(F.lit("Planned and randomised subjects ("), l, F.lit(" planned, "), r, F.lit(" reported)")),
        description=lambda l, r: F.concat(F.lit("Planned are "), l, F.lit(" subjects, reported "), r, F.lit(", "), _percent(l, r), F.lit("% apart.")),
        benign=lambda l, r: F.when(_drift(l, r) < DRIFT, "downgrade").otherwise("none"),
        note=lambda l, r: F.when(_drift(l, r) < DRIFT, F.concat(F.lit("Enrolment ended within "), _percent(l, r), F.lit("% of the plan, which is usual.")))),
    RelatedPair(
        "stat.default_ci_level", "equivalence.ci_level.ratio", True, lambda l, r: l != r,
        title=lambda l, r: F.concat(F.lit("Default and primary confidence level ("), l, F.lit(" default, "), r, F.lit(" primary)")),
        description=lambda l, r: F.concat(F.lit("The default is "), l, F.lit("; the primary criterion uses "), r, F.lit(".")),
        benign=lambda _l, _r: F.lit("mitigate"), note=lambda _l, _r: F.lit("The primary criterion may override the default on purpose; a reviewer has to confirm it.")),
)


def pair_evidence(facts: DataFrame, pairs: Sequence[RelatedPair] = PAIRS) -> DataFrame:
    """Declared pairs of concepts, by the values that documents settle on."""
    down = F.coalesce(_mode() == "downgrade", F.lit(False))
    out = evidence(facts.limit(0), _null(), "RELATED_PAIR", _null(), _null())
    for p in pairs:
        own = facts.where(F.col("conceptKey").isin(p.left, p.right)).withColumn("_side", F.when(F.col("conceptKey") == p.left, "l").otherwise("r")).withColumn("_group", F.col("documentId") if p.same_document else F.lit("all"))
        settled = relational.consensus(own, ["_group", "_side"], "normalizedValue", "entitySeq", down)
        l, r = (settled.where(F.col("_side") == side).select("_group", F.col("consensus").alias(f"_{side}")) for side in ("l", "r"))
        judged = l.join(r, "_group").where(F.coalesce(p.evaluate(F.col("_l"), F.col("_r")), F.lit(False)))
        rows = own.join(judged, "_group").where(F.col("normalizedValue") == F.when(F.col("_side") == "l", F.col("_l")).otherwise(F.col("_r")))
        key = f"{p.left}~{p.right}"
        args = F.col("_l"), F.col("_r")
        out = out.unionByName(evidence(rows, F.concat(F.lit(f"pair|{key}|"), "_group"), "RELATED_PAIR", F.lit(key), F.lit(p.category), severity_key=F.lit(p.left), benign=p.benign(*args), note=p.note(*args), title=p.title(*args), description=p.description(*args)))
    return out


#: How drafts of policies begin.
POLICY = "policy|"


def policy_evidence(facts: DataFrame, summed: bool = False) -> DataFrame:
    """Policies not to compare groups, against tests named in the same document.

    A policy rests on all tests of its document, so evidence grows with policies times tests. Summed, a row
    stands for all tests of a document that count alike: enough for all of a finding but its occurrences.
    """
    policies = facts.where(F.col("conceptKey").startswith("policy.no_statistical_comparison.")).withColumn("times", F.lit(1).cast("long"))
    practice = facts.where("conceptKey = 'practice.statistical_test_on_safety_data'").withColumn("times", F.lit(1).cast("long"))
    tests = practice.groupBy("documentId").agg(F.count_distinct("normalizedValue").alias("_tests"))
    if summed:
        alike = practice.groupBy("documentId", "documentType", "normalizedValue", "extractorRule", "ruleSpecificity", "contextConfirmed")
        practice = alike.agg(F.min_by(F.struct(*facts.columns), "entitySeq").alias("_f"), F.sum("times").alias("times")).select("_f.*", "times")
    held = policies.join(tests, "documentId").withColumn("_draft", F.concat(F.lit(POLICY), F.col("entitySeq").cast("string")))
    rows = held.unionByName(practice.join(held.select("documentId", "_draft", "_tests"), "documentId"))
    return evidence(rows, F.col("_draft"), "VALUE_MISMATCH", F.lit("policy.safety_testing_contradiction"), F.lit("STATISTICAL"), severity=F.lit("MAJOR"), scope=F.lit("INTRA_DOCUMENT"), benign=F.lit("mitigate"),
                    note=F.lit("What counts as safety data may be meant narrowly; a reviewer has to confirm it."), title=F.concat(F.lit("Policy not to compare groups against "), F.col("_tests").cast("string"), F.lit(" named test(s)")), description=F.lit("The document rules comparisons out, and names tests."), times=F.col("times"))


def verdicts(facts: DataFrame) -> DataFrame:
    """(criterion, result, statistic, met, levelMismatch): stated criteria with bounds against the first reported interval of their statistic."""
    number = lambda c, k: F.try_element_at(F.col(f"{c}.attributes"), F.lit(k)).try_cast("double")
    whole = F.struct(*facts.columns)
    criteria = facts.where(F.col("conceptKey").startswith("equivalence.ci_level.") & F.map_contains_key("attributes", "lower")).select(F.try_element_at("attributes", F.lit("statistic")).alias("statistic"), whole.alias("criterion"), (F.col("documentType") == "SAP").alias("_plan"))
    planned = criteria.agg(F.coalesce(F.bool_or("_plan"), F.lit(False)).alias("_any"))  # one row
    criteria = criteria.crossJoin(F.broadcast(planned)).where(F.col("_plan") | ~F.col("_any")).drop("_any")
    observed = facts.where(F.col("conceptKey").startswith("equivalence.observed.")).select(F.try_element_at("attributes", F.lit("statistic")).alias("statistic"), whole.alias("result"))
    first = observed.groupBy("statistic").agg(F.min_by("result", "result.entitySeq").alias("result"))
    met = (number("result", "lower") >= number("criterion", "lower")) & (number("result", "upper") <= number("criterion", "upper"))
    return criteria.join(first, "statistic").select("criterion", "result", "statistic", met.alias("met"), (~number("criterion", "ciLevel").eqNullSafe(number("result", "ciLevel"))).alias("levelMismatch")).where("met IS NOT NULL")


def verdict_evidence(facts: DataFrame) -> DataFrame:
    """One finding if stated criteria lead to opposite verdicts."""
    v = verdicts(facts)
    both = v.agg(F.count_distinct("met").alias("_m"), F.bool_or("levelMismatch").alias("_level"), F.array_join(F.array_sort(F.collect_set(F.concat(F.lower("statistic"), F.when(F.col("met"), " met").otherwise(" not met")))), ", ").alias("_text")).where("_m = 2")
    rows = v.select(F.explode(F.array("criterion", "result")).alias("e")).select("e.*").crossJoin(F.broadcast(both))  # one row or none
    return evidence(rows, F.lit("verdict"), "RELATED_PAIR", F.lit("equivalence.criteria_verdict"), F.lit("STATISTICAL"), severity=F.lit("CRITICAL"), scope=F.lit("CROSS_DOCUMENT"), title=F.lit("Stated criteria lead to opposite verdicts"),
                    description=F.concat(F.lit("Against the stated criteria: "), F.col("_text"), F.when(F.col("_level"), "; an interval is reported at another level than its criterion.").otherwise(".")))


def arithmetic_evidence(checks: DataFrame) -> DataFrame:
    """Recomputations that fail."""
    concept = F.when(F.col("label").rlike("(?i)margin"), "design.equivalence_margin").otherwise(F.concat(F.lit("arithmetic."), "id"))
    failed = checks.where("outcome = 'FAILED'").select(
        "id", "label", "expression", "expected", "stated", "tolerance", F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("entitySeq"), F.col("expression").alias("rawText"), F.col("stated").alias("normalizedValue"), "citation",
        F.lit("arithmetic").alias("extractorRule"), F.lit(1.0).alias("ruleSpecificity"), F.lit(True).alias("contextConfirmed"), F.col("citation.documentId").alias("documentId"), F.col("citation.documentType").alias("documentType"))
    return evidence(failed, F.concat(F.lit("arithmetic|"), "id"), "ARITHMETIC", concept, F.lit("NUMERIC"), scope=F.lit("INTRA_DOCUMENT"), title=F.concat("label", F.lit(" — does not reproduce")),
                    description=F.concat("expression", F.lit(" gives "), "expected", F.lit("; stated is "), "stated", F.lit(" (checked to "), "tolerance", F.lit(").")))


def comparable(facts: DataFrame, include_practice: bool = True) -> tuple[DataFrame, DataFrame]:
    """Facts whose values may be compared with each other, and the concepts (conceptKey) that expect a value instead."""
    own = facts.where("conceptKey <> 'crf_page.reference'")
    expects = F.map_contains_key(F.coalesce("attributes", F.create_map().cast("map<string,string>")), "expected")
    concepts = own.groupBy("conceptKey").agg(F.bool_or(expects).alias("_exp")).where("_exp").select("conceptKey")
    return own.where(~F.col("conceptKey").startswith("assessment.") & (F.lit(include_practice) | ~F.col("conceptKey").startswith("practice."))), concepts


def routed(facts: DataFrame, include_practice: bool = True) -> tuple[DataFrame, DataFrame]:
    """Facts whose values are compared with each other, and facts of concepts that expect a value."""
    plain, concepts = comparable(facts, include_practice)
    return plain.join(concepts, "conceptKey", "left_anti"), facts.where("conceptKey <> 'crf_page.reference'").join(concepts, "conceptKey", "left_semi")


def all_evidence(facts: DataFrame, checks: DataFrame, documents: DataFrame, include_practice: bool = True, pairs: Sequence[RelatedPair] = PAIRS, coverage: Sequence[Coverage] = COVERAGE) -> list[DataFrame]:
    """The evidence of every check, that of policies summed. Page names, assessments and facts with an expected value go their own ways."""
    return [value_evidence(*comparable(facts, include_practice)), expected_evidence(routed(facts)[1]), page_evidence(facts), coverage_evidence(facts, documents, coverage), pair_evidence(facts, pairs), policy_evidence(facts, summed=True), verdict_evidence(facts), arithmetic_evidence(checks)]


def _occurrence() -> Column:
    """What a finding shows of the first fact of a document, value and section."""
    return F.min_by(F.struct("entitySeq", F.col("id").alias("entityId"), F.col("normalizedValue").alias("value"), "rawText", "citation"), "entitySeq")


def _heads(rows: DataFrame, gathered: bool) -> DataFrame:
    """A row for each draft with its sums, its values, and its occurrences: how many, and as a list if they are gathered.

    Occurrences come first: one for each document, value and section of a draft (and concept, which a draft has
    one of), with the sums of its rows. They meet by draft once, and what is left is done where they met.
    """
    head = [c for c in _HEAD[1:] if c != "note"] + ["fixedTypes"]
    kind = F.struct(position(F.col("documentType"), DOCUMENT_TYPES).alias("o"), F.col("documentType").alias("t"))
    least = lambda c, seq, name: F.min_by(c, seq).alias(name)
    total = lambda c: F.sum(c).alias(c)
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    once = rows.withColumn("_at", F.when(F.col("note").isNotNull(), F.col("entitySeq"))).groupBy("draft", "conceptKey", "documentId", "normalizedValue", F.col("citation.sectionId").alias("_section")).agg(
        F.min("entitySeq").alias("_seq"), least(F.struct(*[c for c in head if c != "conceptKey"], F.col("citation.version").alias("version")), "entitySeq", "_head"), F.min("_at").alias("_at"), least("note", "_at", "_note"), F.sum(F.col("ruleSpecificity") * F.col("times")).alias("_spec"), F.coalesce(F.sum(F.when(F.col("ruleSpecificity").isNotNull(), F.col("times"))), F.lit(0)).alias("_specs"),
        F.sum(F.col("contextConfirmed").cast("double") * F.col("times")).alias("_ctx"), F.coalesce(F.sum(F.when(F.col("contextConfirmed").isNotNull(), F.col("times"))), F.lit(0)).alias("_ctxs"), F.collect_set("extractorRule").alias("_rules"), F.collect_set(kind).alias("_types"),
        *([_occurrence().alias("_o")] if gathered else []))
    once = once.withColumn("_head", F.struct("conceptKey", "_head.*")).drop("conceptKey", "documentId", "_section").repartition("draft")
    lower = [least("_head", "_seq", "_head"), least("_note", "_at", "_note"), *[total(c) for c in ("_spec", "_specs", "_ctx", "_ctxs")], union("_rules"), union("_types")]
    value = once.groupBy("draft", "normalizedValue").agg(*lower, F.min("_at").alias("_at"), F.min("_seq").alias("_seq"), F.count("*").alias("_n"), *([F.collect_list("_o").alias("_o")] if gathered else []))
    told = F.transform(F.array_sort("_types"), lambda x: x["t"])
    said = F.concat(F.array_join(told, ", "), F.when(F.size(told) == 1, " states ").otherwise(" state "), "normalizedValue")
    supported = F.size(F.filter("_types", lambda x: x["t"].isNotNull())).cast("long")
    out = value.groupBy("draft").agg(*lower, F.max(supported).alias("_support"), F.array_sort(F.collect_list(F.struct(F.col("_seq").alias("_first"), F.col("normalizedValue").alias("v"), said.alias("said")))).alias("_variants"), total("_n"), *([F.array_sort(F.flatten(F.collect_list("_o"))).alias("occurrences")] if gathered else []))
    means = [(F.col(c) / F.nullif(F.col(f"{c}s"), F.lit(0))).alias(c) for c in ("_spec", "_ctx")]
    return out.select("draft", *[F.col(f"_head.{c}").alias(c) for c in head], F.col("_head.version").alias("_version"), F.col("_note").alias("note"), *means, F.array_sort("_rules").alias("_rules"), F.array_sort("_types").alias("_types"), "_support", "_variants", "_n", *(["occurrences"] if gathered else []))


def drafts_of(rows: DataFrame, gathered: bool = False) -> DataFrame:
    """Findings without ids, with their draft and how many occurrences they have (occurrenceCount); the occurrences themselves if they are gathered."""
    g = _heads(rows, gathered)
    g = g.withColumn("documentTypes", F.coalesce("fixedTypes", F.transform("_types", lambda x: x["t"])))
    g = g.withColumn("scope", F.coalesce("fixedScope", F.when(F.size("_types") > 1, "CROSS_DOCUMENT").otherwise("INTRA_DOCUMENT")))
    g = g.withColumn("_c", score.confidence(F.col("kind"), F.col("_spec"), F.col("_rules"), F.col("_ctx"), F.col("_support"), F.size("_types"), F.col("benign")))
    values = F.transform("_variants", lambda x: x["v"])
    severity = F.coalesce("fixedSeverity", score.severity(F.col("severityKey"), F.col("category"), F.col("benign") == "downgrade"))
    severity = F.when((F.col("kind") == "VALUE_MISMATCH") & F.col("fixedSeverity").isNull() & S.only_case_or_punctuation(values), "MINOR").otherwise(severity)
    summary = F.array_join(values, " / ")
    where = F.when(F.col("scope") == "INTRA_DOCUMENT", F.concat(F.lit("within "), F.get("documentTypes", F.lit(0)), F.lit(" "), "_version")).otherwise(F.concat(F.lit("across "), S.listed(F.col("documentTypes"))))
    title = F.when(F.col("kind") == "CLUSTER", F.concat(F.lit('One page named "'), F.array_join(values, '" and "'), F.lit('"'))).otherwise(F.coalesce("title", F.concat(profiles.label(F.col("conceptKey"), F.col("category")), F.lit(" differs "), where, F.when(F.length(summary) <= 56, F.concat(F.lit(" — "), summary)).otherwise(""))))
    return g.select(
        "conceptKey", "category", severity.alias("severity"), F.col("_c.score").alias("confidence"), F.col("_c.factors").alias("confidenceFactors"), "scope", title.alias("title"), F.coalesce("description", F.concat(F.array_join(F.transform("_variants", lambda x: x["said"]), "; "), F.lit("."))).alias("description"),
        *([F.transform("occurrences", lambda o: o.dropFields("entitySeq")).alias("occurrences")] if gathered else []), "documentTypes", profiles.context(F.col("conceptKey"), F.col("category")).alias("regulatoryContext"), profiles.action(F.col("conceptKey"), F.col("category")).alias("suggestedAction"), F.when(F.col("benign") != "none", F.col("note")).alias("benignNote"),
        F.col("_n").alias("occurrenceCount"), "draft")


def findings_of(rows: DataFrame) -> DataFrame:
    """Findings F-001.. in order: severity, confidence downwards, concept, title; with their draft, without occurrences."""
    g = stored([drafts_of(rows).drop("occurrenceCount")], "drafts")
    order = [position(F.col("severity"), SEVERITIES), -F.col("confidence"), F.collate("conceptKey", "UNICODE"), F.collate("title", "UNICODE"), "draft"]
    # Only what the order needs is dealt into ranges; findings themselves are long.
    ids = relational.dense_ids(g.select("severity", "confidence", "conceptKey", "title", "draft"), order, "F-", 3).select("draft", "id")
    return g.join(ids, "draft").select("id", *[c for c in g.columns if c != "draft"], "draft")


def with_occurrences(findings: DataFrame, rows: DataFrame, facts: DataFrame) -> DataFrame:
    """findings (of findings_of, with the evidence that they were made of) with their occurrences in place of their draft.

    Every policy shows every test of its document, so occurrences may be as many as policies times tests.
    They are joined, not stored: a plan that does not ask for them leaves the join out.
    """
    every = rows.where(~F.col("draft").startswith(POLICY)).unionByName(policy_evidence(facts))
    once = every.groupBy("draft", "conceptKey", "documentId", "normalizedValue", F.col("citation.sectionId").alias("_section")).agg(_occurrence().alias("_o"))
    shown = once.groupBy("draft").agg(F.transform(F.array_sort(F.collect_list("_o")), lambda o: o.dropFields("entitySeq")).alias("occurrences"))
    names = [c for c in findings.columns if c != "draft"]
    at = names.index("description") + 1
    return findings.join(shown, "draft", "left").select(*names[:at], "occurrences", *names[at:])


def concepts_compared(facts: DataFrame, checks: DataFrame, declared: int = len(PAIRS) + len(COVERAGE)) -> DataFrame:
    """One number: concepts, declared pairs and coverage rows, and recomputations."""
    return facts.agg(F.count_distinct("conceptKey").alias("n")).crossJoin(checks.agg(F.count("*").alias("m"))).select((F.col("n") + F.col("m") + declared).alias("conceptsCompared"))
