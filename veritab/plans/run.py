"""The whole run: items and descriptors to facts, recomputations and findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.model import ABBREVIATIONS, SECTIONS
from veritab.operators import arithmetic, compare, contextual, ingest
from veritab.operators.catalogue import CONTEXTUAL, ORDER, RULES
from veritab.operators.review import AuditLog
from veritab.operators.rules import Rule, entities_of, extract
from veritab.plans.scratch import stored

RULESET = "1.0"


class Extractor(Protocol):
    """What finds facts; swap it to use another catalogue or a model."""

    def extract(self, paragraphs: DataFrame, sections: DataFrame, abbreviations: DataFrame) -> DataFrame: ...


class RuleExtractor:
    """Facts by the catalogue, or by some of its rules."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = RULES if rules is None else rules

    def extract(self, paragraphs: DataFrame, sections: DataFrame, abbreviations: DataFrame) -> DataFrame:
        ids = {r.id for r in self.rules}
        own = {ORDER.get(r.id, len(ORDER) + i): r for i, r in enumerate(self.rules) if r.id not in CONTEXTUAL}
        parts = extract(paragraphs, own)
        if "terminology.acronym_definition" in ids:
            parts.append(contextual.acronyms(paragraphs, abbreviations))
        if ids & {"crossref.reference_resolution", "crossref.numbered_title_reference"}:
            parts.append(contextual.references(paragraphs, sections).where(F.col("extractorRule").isin(list(ids))))
        if "crf_mapping.page_reference" in ids:
            parts.append(contextual.page_references(paragraphs, abbreviations))
        if "derivation.dataset_flow" in ids:
            parts.append(contextual.dataset_flows(paragraphs))
        return entities_of(stored(parts, "hits"))


@dataclass
class Result:
    documents: DataFrame
    paragraphs: DataFrame
    sections: DataFrame
    abbreviations: DataFrame
    entities: DataFrame
    arithmetic: DataFrame
    findings: DataFrame
    ruleset: str = RULESET
    timestamp: str = ""


#: The stages of a run, in order.
STAGES = ("INGEST", "DEBOILERPLATE", "STRUCTURE", "EXTRACT", "COMPARE", "SCORE")
Stage = Callable[[str, dict[str, int]], None]


def analyse(
    paragraphs: DataFrame, sections: DataFrame | None = None, abbreviations: DataFrame | None = None, documents: DataFrame | None = None, extractor: Extractor | None = None, include_practice: bool = True,
    on_stage: Stage | None = None, timestamp: str = "", log: AuditLog | None = None, pairs: Sequence[compare.RelatedPair] = compare.PAIRS, coverage: Sequence[compare.Coverage] = compare.COVERAGE,
) -> Result:
    """Facts, recomputations and findings of indexed paragraphs. Each step is a table in the shared folder: computed once, and planned alone.

    on_stage gets each stage's name and counters; log gets the run's events.
    """
    spark: SparkSession = paragraphs.sparkSession
    say = on_stage or (lambda _stage, _counters: None)
    sections = spark.createDataFrame([], SECTIONS) if sections is None else sections
    abbreviations = spark.createDataFrame([], ABBREVIATIONS) if abbreviations is None else abbreviations
    documents = paragraphs.select("documentId", "documentType").distinct() if documents is None else documents
    entities = stored([(extractor or RuleExtractor()).extract(paragraphs, sections, abbreviations)], "facts")
    found = entities.agg(F.count("*").alias("entities"), F.count_distinct("conceptKey").alias("concepts")).first().asDict()
    if log:
        log.append("EXTRACTION_COMPLETED", f"{found['entities']} facts of {found['concepts']} concepts from {paragraphs.count()} paragraphs", timestamp)
    say("EXTRACT", found)
    checks = stored([arithmetic.checks_of(entities, paragraphs)], "checks")
    done = checks.agg(F.count("*").alias("checks"), F.count_if(F.col("outcome") == "CONFIRMED").alias("confirmed")).first().asDict()
    say("COMPARE", done)
    evidence = stored(compare.all_evidence(entities, checks, documents, include_practice, pairs, coverage), "evidence")
    findings = compare.with_occurrences(stored([compare.findings_of(evidence)], "findings"), evidence, entities)
    scored = {"findings": findings.count(), "conceptsCompared": compare.concepts_compared(entities, checks, len(pairs) + len(coverage)).first()[0]}
    if log:
        log.append("ANALYSIS_COMPLETED", f"{scored['findings']} findings from {scored['conceptsCompared']} concepts, declared checks and recomputations", timestamp)
    say("SCORE", scored)
    return Result(documents, paragraphs, sections, abbreviations, entities, checks, findings, timestamp=timestamp)


def run_pipeline(items: DataFrame, descriptors: DataFrame, pages: DataFrame | None = None, **options) -> Result:
    """From positioned items to findings. options as for analyse()."""
    say = options.get("on_stage") or (lambda _stage, _counters: None)
    tables = ingest.ingest(items, descriptors, pages)
    kept = {name: stored([tables[name]], name) for name in ("paragraphs", "sections", "abbreviations", "documents")}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    read = kept["documents"].agg(F.count("*").alias("documents"), total("pdfPageCount").alias("pages"), total("rotatedItemsDropped").alias("rotated"), total(F.size(F.coalesce("boilerplate", F.array().cast("array<string>")))).alias("repeated"), total("linesRemoved").alias("lines")).first()
    say("INGEST", {"documents": read["documents"], "pages": read["pages"]})
    say("DEBOILERPLATE", {"rotatedItems": read["rotated"], "repeatedLines": read["repeated"], "linesRemoved": read["lines"]})
    say("STRUCTURE", {"sections": kept["sections"].count(), "paragraphs": kept["paragraphs"].count()})
    if options.get("log"):
        events = ingested(kept["documents"], kept["sections"], kept["paragraphs"])
        options["log"].append_table(events.select(F.lit("DOCUMENT_INGESTED").alias("eventType"), "detail", F.lit(options.get("timestamp", "")).alias("timestamp"), "docSeq", "documentId"), ["docSeq", "documentId"])
    return analyse(**kept, **options)


def ingested(documents: DataFrame, sections: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(docSeq, documentId, detail): what the log says of each document that was read."""
    count = lambda df, name: df.groupBy("documentId").agg(F.count("*").alias(name))
    d = documents.join(count(sections, "_s"), "documentId", "left").join(count(paragraphs, "_p"), "documentId", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    detail = F.concat("documentType", F.lit(" "), "version", F.lit(" ("), "fileName", F.lit("): "), n("pdfPageCount"), F.lit(" pages, "), n("printedPageCount"), F.lit(" printed, offset "), n("pageOffset"), F.when(F.col("consistent"), "").otherwise(" (not the same on all pages)"), F.lit("; "), n("_s"), F.lit(" sections, "), n("_p"), F.lit(" paragraphs"))
    return d.select("docSeq", "documentId", detail.alias("detail"))


class Runner:
    """One run at a time: IDLE, RUNNING, then READY with a result or FAILED with an error."""

    def __init__(self):
        self.state, self.result, self.error = "IDLE", None, None

    def run(self, *args, **options) -> Result | None:
        if self.state == "RUNNING":
            return None
        self.state, self.result, self.error = "RUNNING", None, None
        try:
            self.result = run_pipeline(*args, **options)
            self.state = "READY"
        except Exception as e:
            self.state, self.error = "FAILED", e
            raise
        return self.result
