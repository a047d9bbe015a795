"""Sinks: audit CSV, report JSON, printed report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import citation_label, fixed
from veritab.model import SEVERITIES, position
from veritab.operators.review import below_threshold
from veritab.sources.document_sink import Frame, json_lists, write_document

AUDIT = ["id", "timestamp", "actor", "eventType", "detail", "rulesetVersion"]


def audit_csv(events: DataFrame, path: str) -> None:
    """Events with all values quoted and quotes doubled, in the order of their ids."""
    events.select(*AUDIT).orderBy(F.substring("id", 4, 20).cast("long")).write.option("header", True).option("quoteAll", True).option("escape", '"').option("quote", '"').csv(path)


def csv_lines(events: DataFrame) -> DataFrame:
    """(id, line): each event's line of the CSV."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in AUDIT]
    return events.select("id", F.concat_ws(",", *quoted).alias("line"))


def audit_file(events: DataFrame, path: str) -> None:
    """The CSV of audit_csv as one file, by tasks."""
    header = ",".join(f'"{c}"' for c in AUDIT) + "\n"
    number = F.substring("id", 4, 20).cast("long")
    lines = csv_lines(events)
    write_document([(Frame(header, "\n", "\n" if events.take(1) else ""), lines, "line", [number, "id"])], path)


def _number(c: Column | str) -> Column:
    """The number in an id like F-001."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("decimal(38,0)")


def report_json(run: dict, findings: DataFrame, checks: DataFrame, documents: DataFrame, path: str, sign_off: dict | None = None) -> None:
    """The report as one JSON document at path: a line for each document, recomputation and finding, in order; no row holds them all."""
    lists = [("documents", documents, ["documentId"]), ("arithmetic", checks, [_number("id"), "id"]), ("findings", findings, [_number("id"), "id"])]
    json_lists(run, lists, {"signOff": sign_off}, path)


def report_text(findings: DataFrame, checks: DataFrame, documents: DataFrame, path: str, run: dict | None = None, sign_off: dict | None = None) -> None:
    """The printed report as one text file."""
    write_document([(Frame("", "\n\n", "\n"), printed_report(findings, checks, documents, run, sign_off), "text", ["block", "ord"])], path)


#: What a report says of itself.
CLOSING = "The findings come from fixed rules over the documents listed; each waits for a person's decision, and no document was changed."


def printed_findings(findings: DataFrame) -> DataFrame:
    """(severity, severityOrd, id, text): findings by severity, in order, with their citations, context, action and decision."""
    cited = F.transform("occurrences", lambda o: F.concat(citation_label(o["citation"]["documentType"], o["citation"]["version"], o["citation"]["sectionId"], o["citation"]["printedPage"], o["citation"]["pdfPage"]), F.lit(": "), o["value"], F.lit('\n    "'), o["citation"]["snippet"], F.lit('"')))
    decided = F.coalesce(F.concat(F.col("disposition.status"), F.lit(" by "), F.col("disposition.reviewer"), F.lit(": "), F.col("disposition.comment")), F.lit("open")) if "disposition" in findings.columns else F.lit("open")
    unsure = F.when(below_threshold(F.col("confidence")), F.lit(" (below the review threshold)")).otherwise("")
    body = F.concat("id", F.lit("  "), "title", F.lit("\n  "), "description", F.lit("\n  - "), F.array_join(cited, "\n  - "), F.lit("\n  Why it matters: "), F.coalesce("regulatoryContext", F.lit("")), F.lit("\n  Action: "), F.coalesce("suggestedAction", F.lit("")), F.lit("\n  Confidence "), fixed(F.col("confidence"), 2), unsure, F.lit("; "), decided)
    return findings.select("severity", position(F.col("severity"), SEVERITIES).alias("severityOrd"), "id", body.alias("text"))


def printed_report(findings: DataFrame, checks: DataFrame, documents: DataFrame, run: dict | None = None, sign_off: dict | None = None) -> DataFrame:
    """(block, ord, text): header with counts, the documents, recomputations, findings by severity, and the sign-off."""
    run = run or {}
    counted = findings.agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    sized = documents.agg(F.count("*").alias("d"))
    head = counted.crossJoin(sized).select(F.concat(F.lit("".join(f"{k}: {v}\n" for k, v in run.items())), F.lit("Documents: "), F.col("d").cast("string"), F.lit("\nFindings: "), F.col("n").cast("string"), *[x for s in SEVERITIES for x in (F.lit(f", {s.lower()} "), F.col(s).cast("string"))]).alias("text"))  # single rows
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in documents.columns else F.lit("")
    listed = documents.select(F.lit(1).alias("block"), F.concat_ws("|", F.lpad(F.coalesce(F.col("docSeq"), F.lit(0)).cast("string") if "docSeq" in documents.columns else F.lit("0"), 9, "0"), column("documentId")).alias("ord"), F.concat_ws(" | ", column("documentType"), column("version"), column("effectiveDate"), column("author"), F.concat(column("printedPageCount"), F.lit(" printed / "), column("pdfPageCount"), F.lit(" pages"))).alias("text"))
    derived = checks.agg(F.count_if(F.col("outcome") == "CONFIRMED").alias("ok"), F.count("*").alias("n")).select(F.lit(2).alias("block"), F.lit("").alias("ord"), F.concat(F.col("ok").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" recomputed derivations give what is stated.")).alias("text"))
    body = printed_findings(findings).select(F.lit(3).alias("block"), F.concat(F.col("severityOrd").cast("string"), F.lpad(F.substring("id", 3, 20), 20, "0")).alias("ord"), F.concat("severity", F.lit("  "), "text").alias("text"))
    signed = f"Signed off by {sign_off['reviewer']} at {sign_off['timestamp']}." if sign_off else "Reviewer: ____________  Date: ________\nApprover: ____________  Date: ________"
    last = counted.select(F.lit(4).alias("block"), F.lit("").alias("ord"), F.lit(f"{signed}\n{CLOSING}").alias("text"))
    parts = head.select(F.lit(0).alias("block"), F.lit("").alias("ord"), "text")
    for part in (listed, derived, body, last):
        parts = parts.unionByName(part)
    return parts.orderBy("block", "ord")
