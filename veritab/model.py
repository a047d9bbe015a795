"""Fixed values of the model: document types, categories, severities and their orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Document types in their declared order.
DOCUMENT_TYPES = ("PROTOCOL", "SAP", "CSR", "CRF", "IB")
#: Categories of facts.
CATEGORIES = ("NUMERIC", "STATISTICAL", "ENDPOINT", "POPULATION", "SCHEDULE", "CROSSREF", "CRF_MAPPING", "DERIVATION", "COVERAGE", "TERMINOLOGY", "EDITORIAL")
#: Severities, gravest first.
SEVERITIES = ("CRITICAL", "MAJOR", "MINOR")
SCOPES = ("INTRA_DOCUMENT", "CROSS_DOCUMENT")

HIT = "struct<conceptKey:string,rawText:string,normalizedValue:string,unit:string,index:int,attributes:map<string,string>>"
PARAGRAPHS = (
    "documentId string, documentType string, documentTitle string, version string, author string, sectionId string, sectionHeading string, paragraphId string, "
    "printedPage int, pdfPage int, text string, lines array<string>, kind string, docSeq int, sectionSeq int, paraSeq int"
)
SECTIONS = "documentId string, sectionSeq int, id string, heading string, printedPage int, pdfPage int"
ABBREVIATIONS = "documentId string, abbrSeq int, acronym string, expansion string, paragraphId string"
ITEMS = "documentId string, pdfPage int, itemSeq int, text string, x double, y double, width double, height double, rotation int, fontFamily string"
DESCRIPTORS = "id string, type string, fileName string, title string, version string, effectiveDate string, author string"
AUDIT_EVENTS = "id string, timestamp string, actor string, eventType string, detail string, rulesetVersion string"


def position(value: Column, order: tuple[str, ...]) -> Column:
    """Place of value in order, from 0; the length of order for others."""
    out = F.lit(len(order))
    for i in reversed(range(len(order))):
        out = F.when(value == order[i], i).otherwise(out)
    return out


def chosen(value: Column, table: list[tuple[str, str]], default: Column) -> Column:
    """The second item of the first row of table whose pattern value matches, else default."""
    out = default
    for pattern, result in reversed(table):
        out = F.when(value.rlike(pattern), F.lit(result)).otherwise(out)
    return out
