"""Extraction rules: a declarative catalogue, compiled into one projection over paragraphs.

A rule is a gate on the paragraph and some patterns; a pattern maps each match to a hit. All
rules that look at one paragraph only are evaluated in a few projections: no shuffle, no Python. A cheap test comes before each rule's extraction, so that groups are extracted only
where the pattern occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import literals
from veritab.functions.matches import let, matches
from veritab.functions.scalars import snippet, tidy
from veritab.model import HIT
from veritab.operators import relational
from veritab.plans.scratch import stored_by

Groups = Callable[[int], Column]
#: Rules in one projection. Plans of all rules together take Spark longer than further looks at the paragraphs.
TOGETHER = 8


@dataclass(frozen=True)
class Pattern:
    """regex with groups, and what a match means; value may be null: then there is no hit."""

    regex: str
    groups: int
    key: Callable[[Groups], Column] | str
    value: Callable[[Groups], Column] | str
    unit: Callable[[Groups], Column] | str | None = None
    attributes: dict[str, Callable[[Groups], Column]] = field(default_factory=dict)
    #: Condition on the paragraph's text.
    when: str | None = None
    raw_length: int | None = None


@dataclass(frozen=True)
class Benign:
    pattern_id: str
    regex: str
    mode: str
    note: str


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    description: str
    specificity: float
    patterns: tuple[Pattern, ...] = ()
    #: For rules that patterns can't say: paragraph columns to an array of hits.
    hits: Callable[[], Column] | None = None
    document_types: tuple[str, ...] = ()
    kind: str | None = None
    excludes_heading: str | None = None
    excludes: str | None = None
    requires: str | None = None
    benign: Benign | None = None


def made(x, groups: Groups) -> Column:
    return F.lit(None).cast("string") if x is None else F.lit(x) if isinstance(x, str) else x(groups)


def attributes_of(values: dict[str, Column]) -> Column:
    """A map of the values that are not null; null if the rule has no attributes."""
    if not values:
        return F.lit(None).cast("map<string,string>")
    whole = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def hit(key: Column, raw: Column, value: Column, unit: Column, index: Column, attributes: Column) -> Column:
    return F.struct(key.alias("conceptKey"), raw.alias("rawText"), value.alias("normalizedValue"), unit.alias("unit"), index.cast("int").alias("index"), attributes.alias("attributes"))


def pattern_hits(p: Pattern, text: Column) -> Column:
    def one(match: Column) -> Column:
        g: Groups = lambda k: match["m"][k]
        raw = tidy(g(0)) if p.raw_length is None else F.left(tidy(g(0)), F.lit(p.raw_length))
        return hit(made(p.key, g), raw, made(p.value, g), made(p.unit, g), match["index"], attributes_of({k: v(g) for k, v in p.attributes.items()}))

    found = F.filter(F.transform(matches(text, p.regex, p.groups), one), lambda h: h["normalizedValue"].isNotNull())
    return found if p.when is None else F.when(text.rlike(p.when), found).otherwise(F.array().cast(f"array<{HIT}>"))


def applies(rule: Rule) -> Column:
    """Whether a rule is for documents and paragraphs of this kind."""
    out = F.lit(True)
    if rule.document_types:
        out = out & F.col("documentType").isin(list(rule.document_types))
    if rule.kind:
        out = out & (F.col("kind") == rule.kind)
    return F.coalesce(out, F.lit(False))


def gate(rule: Rule) -> Column:
    """Whether a rule applies to the paragraph."""
    out = applies(rule)
    if rule.excludes_heading:
        out = out & ~F.coalesce(F.col("sectionHeading"), F.lit("")).rlike(rule.excludes_heading)
    if rule.excludes:
        out = out & ~F.col("text").rlike(rule.excludes)
    if rule.requires:
        out = out & F.col("text").rlike(rule.requires)
    return F.coalesce(out, F.lit(False))


def benign_of(rule: Rule) -> Column:
    kind = "struct<patternId:string,mode:string,note:string>"
    if rule.benign is None:
        return F.lit(None).cast(kind)
    b = rule.benign
    return F.when(F.col("text").rlike(b.regex), F.struct(F.lit(b.pattern_id).alias("patternId"), F.lit(b.mode).alias("mode"), F.lit(b.note).alias("note")).cast(kind))


def tagged(rule: Rule, order: int, hits: Column) -> Column:
    """hits of a rule with the rule's own columns and their order in it."""
    return F.transform(
        hits,
        lambda h, i: F.struct(
            F.lit(order).alias("ruleOrd"), i.alias("hitOrd"), F.lit(rule.id).alias("extractorRule"), F.lit(rule.category).alias("category"), F.lit(float(rule.specificity)).alias("ruleSpecificity"), h.alias("hit"), benign_of(rule).alias("benign")
        ),
    )


def needs_of(rule: Rule) -> literals.Needs:
    """Alternatives of literals that a paragraph must hold for the rule to fire; one without any where the rule is not said by patterns."""
    own = [literals.both(literals.needed(p.regex), literals.needed(p.when) if p.when else literals.NOTHING) for p in rule.patterns]
    fires = literals.NOTHING if rule.hits or not own else literals.either(*own)
    return literals.both(fires, literals.needed(rule.requires)) if rule.requires else fires


def may_fire(rules: dict[int, Rule]) -> Column:
    """array<int>: the rules, by their order, that may fire in a paragraph: an index from literals to rules, looked at once a paragraph.

    Every literal is sought once, whichever rules need it. A rule that is left out cannot match.
    """
    needs = {order: needs_of(rule) for order, rule in rules.items()}
    words = sorted({s for n in needs.values() for a in n for s in a})
    place = {s: k for k, s in enumerate(words)}
    sought = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for s, k in place.items()]) if words else F.array().cast("array<struct<k:int,s:string>>")
    postings = F.array(*[F.struct(F.lit(order).alias("rule"), F.array(*[F.lit(place[s]) for s in sorted(a)]).cast("array<int>").alias("all")) for order, n in sorted(needs.items()) for a in sorted(n, key=sorted)])
    held = let({"low": F.lower("text")}, lambda v: F.transform(F.filter(sought, lambda e: F.contains(v["low"], e["s"])), lambda e: e["k"]))
    met = let({"held": held}, lambda v: F.array_distinct(F.transform(F.filter(postings, lambda a: F.forall(a["all"], lambda k: F.array_contains(v["held"], k))), lambda a: a["rule"])))
    other = [F.when(~applies(rule), F.lit(order)) for order, rule in sorted(rules.items()) if rule.document_types or rule.kind]
    return F.array_except(met, F.array_compact(F.array(*other))) if other else met


def candidates(paragraphs: DataFrame, rules: dict[int, Rule]) -> DataFrame:
    """paragraphs, each with those rules that may fire in it and lie in one group of TOGETHER, as _fire; _group is the group's number.

    The one look at all paragraphs; the table is stored by group.
    """
    group = {order: k // TOGETHER for k, order in enumerate(sorted(rules))}
    groups = F.create_map(*[F.lit(x) for pair in group.items() for x in pair])
    fire = relational.dealt(paragraphs).withColumn("_fire", F.coalesce(may_fire(rules), F.array().cast("array<int>")))  # a condition on _fire would work it out twice
    return stored_by(fire.withColumn("_group", F.explode(F.array_distinct(F.transform("_fire", lambda r: groups[r])))), "_group", "candidates")


def extract(paragraphs: DataFrame, rules: dict[int, Rule]) -> list[DataFrame]:
    """paragraphs joined with the hits of rules, by their order in the catalogue.

    Paragraphs are looked at once, for the literals that rules need; TOGETHER rules at a time then
    look at the paragraphs that they may fire in.
    """
    text, ordered, out = F.col("text"), sorted(rules.items()), []
    if not ordered:
        return []
    found_in = candidates(paragraphs, rules)
    for k in range(0, len(ordered), TOGETHER):
        arrays = []
        for order, rule in ordered[k : k + TOGETHER]:
            parts = [pattern_hits(p, text) for p in rule.patterns] + ([rule.hits()] if rule.hits else [])
            found = parts[0] if len(parts) == 1 else F.concat(*parts)
            arrays.append(tagged(rule, order, F.when(F.array_contains("_fire", order) & gate(rule), found).otherwise(F.array().cast(f"array<{HIT}>"))))
        own = found_in.where(F.col("_group") == k // TOGETHER)
        out.append(own.select(*paragraphs.columns, F.inline(F.flatten(F.array(*arrays)))))
    return out


def entities_of(hits: DataFrame) -> DataFrame:
    """Facts: of equal (document, paragraph, concept, value) the first by order stays; with citation and sequence.

    entitySeq orders facts by document, section, paragraph, rule and hit; it is dense over all
    documents, and counted in ranges of that order, so no task sorts all facts or all documents.
    """
    from pyspark.sql import Window

    order = ["docSeq", "sectionSeq", "paraSeq", "ruleOrd", "hitOrd"]
    key = Window.partitionBy("documentId", "paragraphId", "hit.conceptKey", "hit.normalizedValue").orderBy(*order)
    first = hits.withColumn("_n", F.row_number().over(key)).where("_n = 1").drop("_n")
    out = relational.dense_numbers(first, ["docSeq", "documentId", *order[1:]], "entitySeq")
    citation = F.struct("documentId", "documentType", "version", "author", "sectionId", "sectionHeading", "printedPage", "pdfPage", "paragraphId", snippet(F.col("text"), F.col("hit.index"), F.length("hit.rawText")).alias("snippet"))
    return out.select(
        F.concat(F.lit("ENT-"), F.when(F.col("entitySeq") < 10000, F.lpad(F.col("entitySeq").cast("string"), 4, "0")).otherwise(F.col("entitySeq").cast("string"))).alias("id"),
        "entitySeq", F.col("hit.conceptKey").alias("conceptKey"), "category", F.col("hit.rawText").alias("rawText"), F.col("hit.normalizedValue").alias("normalizedValue"), F.col("hit.unit").alias("unit"),
        citation.alias("citation"), "extractorRule", "ruleSpecificity", F.lit(True).alias("contextConfirmed"), "benign", F.col("hit.attributes").alias("attributes"), "docSeq", "documentId", "documentType",
    )
