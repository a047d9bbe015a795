"""Recomputation of stated derivations. Each validator is a projection or a few joins; ids follow the validators' order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions.matches import matches
from veritab.operators import relational

W = S.WS
#: A row of a table by region, and how dose intensities are stated.
ROW = r"^([A-Za-z][A-Za-z \-']*?)\s+([\d,]+)\s+([\d,]+)\s+([\d,]+)$"
INTERVAL = r"(?i)cycle interval of (\d+) days"
DOSE = r"(?i)(?:planned (?:maintenance )?dose is|planned dose is) ([\d.]+) (mg/kg|mg/m2), giving (?:a planned dose intensity of )?([\d.]+)"
COLUMNS = ("first treatment column", "second treatment column", "total column")


def _citation(snippet: Column) -> Column:
    return F.struct("documentId", "documentType", "version", "author", "sectionId", "sectionHeading", "printedPage", "pdfPage", "paragraphId", snippet.alias("snippet"))


def _check(df: DataFrame, order: int, seq: Column, label: Column, expression: Column, expected: Column, stated: Column, ok: Column, tolerance: Column, citation: Column) -> DataFrame:
    return df.select(
        F.lit(order).alias("_o"), seq.cast("long").alias("_q"), label.alias("label"), expression.alias("expression"), expected.alias("expected"), stated.alias("stated"),
        F.when(ok, "CONFIRMED").otherwise("FAILED").alias("outcome"), tolerance.alias("tolerance"), citation.alias("citation"))


def _place() -> Column:
    return F.col("docSeq").cast("long") * 10**12 + F.col("sectionSeq").cast("long") * 10**7 + F.col("paraSeq").cast("long") * 10


def table_totals(paragraphs: DataFrame) -> DataFrame:
    """Rows of a table by region add up to its Total row, column by column."""
    own = paragraphs.where(F.col("text").rlike("(?i)subjects by geographic region"))
    key = ["documentId", "docSeq", "sectionSeq", "paraSeq"]
    number = lambda k: F.replace(F.regexp_extract("line", ROW, k), F.lit(","), F.lit("")).try_cast("long")
    rows = own.select(*key, F.posexplode("lines").alias("p", "line")).where(F.col("line").rlike(ROW)).select(*key, "p", (F.lower(F.regexp_extract("line", ROW, 1)) == "total").alias("total"), F.array(number(2), number(3), number(4)).alias("v"))
    sums = rows.groupBy(*key).agg(
        F.count_if(~F.col("total")).alias("n"), F.max_by("v", F.when(F.col("total"), F.col("p"))).alias("stated"),
        *[F.sum(F.when(~F.col("total"), F.get("v", F.lit(i)))).alias(f"s{i}") for i in range(3)],
        F.array_sort(F.collect_list(F.when(~F.col("total"), F.struct("p", "v")))).alias("parts")).where("n >= 2 AND stated IS NOT NULL")
    each = own.join(sums, key).select("*", F.posexplode(F.array("s0", "s1", "s2")).alias("_k", "_sum"))
    stated = F.get("stated", F.col("_k"))
    total_line = F.get(F.filter("lines", lambda x: x.rlike("(?i)^total")), F.lit(0))
    name = F.get(F.array(*[F.lit(c) for c in COLUMNS]), F.col("_k"))
    terms = F.array_join(F.transform("parts", lambda p: F.get(p["v"], F.col("_k")).cast("string")), " + ")
    return _check(each, 1, _place() + F.col("_k"), F.concat(F.lit("Table by region — "), name, F.lit(" sums to its total")), terms, F.col("_sum").cast("string"), stated.cast("string"), F.col("_sum") == stated, F.lit("exact"), _citation(total_line))


def _first(facts: DataFrame, concept: str, numeric: bool = True) -> DataFrame:
    own = facts.where(F.col("conceptKey") == concept)
    if numeric:
        own = own.where(F.col("normalizedValue").try_cast("double").isNotNull())
    return own.agg(F.min_by(F.struct("normalizedValue", "citation", "attributes"), "entitySeq").alias("f")).where("f IS NOT NULL")  # one row or none


def inflation(facts: DataFrame) -> DataFrame:
    """Evaluable subjects, inflated for dropouts, give the subjects per group; twice those give the total."""
    one = {k: _first(facts, c, n).select(F.col("f").alias(k)) for k, c, n in (("e", "sample_size.evaluable_per_arm", True), ("g", "sample_size.planned_per_arm", True), ("p", "sample_size.planned", True), ("d", "design.dropout_rate", False))}
    base = one["e"].crossJoin(one["g"]).crossJoin(one["d"])  # single rows
    number = lambda c: F.col(f"{c}.normalizedValue").try_cast("double")
    rate = F.replace(F.col("d.normalizedValue"), F.lit("%"), F.lit("")).try_cast("double") / 100
    inflated, group = number("e") / (1 - rate), number("g")
    first = _check(base, 2, F.lit(0), F.lit("Sample size inflated for dropouts gives the subjects per group"), F.concat(F.col("e.normalizedValue"), F.lit(" evaluable / (1 - "), F.col("d.normalizedValue"), F.lit(") = "), S.fixed(inflated, 2)), F.floor(inflated + 0.5).cast("string"), S.number_text(group), F.abs(inflated - group) <= 1, F.lit("+/- 1 subject (rounding)"), F.col("g.citation"))
    both = base.crossJoin(one["p"])
    second = _check(both, 2, F.lit(1), F.lit("Subjects per group doubled give the total"), F.concat(S.number_text(group), F.lit(" x 2")), S.number_text(group * 2), F.col("p.normalizedValue"), group * 2 == number("p"), F.lit("exact"), F.col("p.citation"))
    return first.unionByName(second)


def dose_intensity(paragraphs: DataFrame) -> DataFrame:
    """Dose divided by the cycle's days, to half a unit of the last stated digit."""
    own = paragraphs.where(F.col("text").rlike(INTERVAL)).select("*", F.regexp_extract("text", INTERVAL, 1).cast("double").alias("_days"), F.posexplode(matches(F.col("text"), DOSE, 3)).alias("_k", "_m"))
    g = lambda k: F.get(F.col("_m.m"), F.lit(k))
    computed, stated, digits = g(1).try_cast("double") / F.col("_days"), g(3).try_cast("double"), S.decimals_of(g(3))
    tolerance = 0.5 * F.pow(F.lit(10.0), -digits)
    shown = F.when(digits <= 4, S.fixed(computed, 4)).when(digits == 5, S.fixed(computed, 5)).otherwise(S.fixed(computed, 6))
    return _check(own, 3, _place() + F.col("_k"), F.concat(F.lit("Planned dose intensity for "), g(1), F.lit(" "), g(2)), F.concat(g(1), F.lit(" "), g(2), F.lit(" / "), S.number_text(F.col("_days")), F.lit(" days")), shown, g(3), F.abs(computed - stated) <= tolerance, F.concat(F.lit("+/- "), S.number_text(tolerance)), _citation(S.tidy(g(0))))


def margin(facts: DataFrame) -> DataFrame:
    """The margin is its base times its factor, exactly."""
    own = _first(facts, "design.equivalence_margin", numeric=False)
    a = lambda k: F.try_element_at("f.attributes", F.lit(k)).try_cast("double")
    computed = a("base") * a("factor")
    return _check(own.where(computed.isNotNull()), 4, F.lit(0), F.lit("Equivalence margin follows from its derivation"), F.concat(S.number_text(a("base")), F.lit("% x "), S.number_text(a("factor"))), F.concat(S.fixed(computed, 2), F.lit("%")), F.concat(S.number_text(a("stated")), F.lit("%")), F.abs(computed - a("stated")) < 1e-9, F.lit("exact"), F.col("f.citation"))


def arm_totals(facts: DataFrame) -> DataFrame:
    """Two arms' counts add up to the stated total."""
    a = lambda k: F.try_element_at("attributes", F.lit(k)).try_cast("double")
    total = F.col("normalizedValue").try_cast("double")
    own = facts.where((a("armA") + a("armB") + total).isNotNull())
    return _check(own, 5, F.col("entitySeq"), F.concat(F.lit("Counts of the arms add up ("), F.replace(F.col("conceptKey"), F.lit("sample_size."), F.lit("")), F.lit(")")), F.concat(S.number_text(a("armA")), F.lit(" + "), S.number_text(a("armB"))), S.number_text(a("armA") + a("armB")), S.number_text(total), a("armA") + a("armB") == total, F.lit("exact"), F.col("citation"))


def checks_of(facts: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """All recomputations, with ids AC-001.. in the validators' order."""
    out = table_totals(paragraphs)
    for part in (inflation(facts), dose_intensity(paragraphs), margin(facts), arm_totals(facts)):
        out = out.unionByName(part)
    return relational.dense_ids(out, ["_o", "_q"], "AC-", 3).drop("_o", "_q")
