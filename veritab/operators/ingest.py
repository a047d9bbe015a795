"""From positioned text items to sections and paragraphs, as windows and folds per page or document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.scalars import WS
from veritab.operators import relational, scans
from veritab.plans.scratch import stored

#: Fixed values of page geometry.
ROTATION, LINE_REACH, FOOTER_Y, BAND, SHARE = 3, 2.2, 110.0, 6.0, 0.6
GAP_LEAST, GAP_SHARE, HEADING_SIZE, PARAGRAPH = 1.2, 0.22, 9.9, 1.28
#: How page numbers stand in footers; tokens that mark redactions.
FOOTERS = [r"(?i)page\s+(\d+)\s+of\s+(\d+)", r"(?i)page\s+(\d+)\s*/\s*(\d+)", r"^[-–—]\s*(\d+)\s*[-–—]$"]
REDACTED = r"^(?:PPD|CCI|REDACTED|X{3,})$"
PAGE = ["documentId", "pdfPage"]


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def upright(items: DataFrame) -> DataFrame:
    """Items that are not rotated."""
    return items.where(F.abs("rotation") <= ROTATION)


def rotated_dropped(items: DataFrame) -> DataFrame:
    return items.groupBy("documentId").agg(F.count_if(F.abs("rotation") > ROTATION).alias("rotatedItemsDropped"))


def lines_of(items: DataFrame) -> DataFrame:
    """Lines of each page: items whose y is within reach of the line's first item, from top to bottom."""
    own = items.where(F.trim("text") != "")
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "itemSeq", "text", "width", "height", "fontFamily")))
    pages = own.groupBy(*PAGE).agg(sorted_.alias("i"))  # a page's items; pages are small
    numbered = pages.select(*PAGE, F.arrays_zip("i", relational.anchored(F.transform("i", lambda x: x["ny"]), LINE_REACH).alias("n")).alias("z")).select(*PAGE, F.inline("z")).select(*PAGE, "n", "i.*")
    w = Window.partitionBy(*PAGE, "n").orderBy("x", "itemSeq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    spaced = numbered.withColumn("t", F.concat(F.when(gap > F.greatest(F.lit(GAP_LEAST), GAP_SHARE * F.col("height")), " ").otherwise(""), "text")).withColumn("k", F.row_number().over(w))
    out = spaced.groupBy(*PAGE, "n").agg(
        squeezed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "")).alias("text"), F.min("x").alias("x"), F.max_by(-F.col("ny"), F.struct(-F.col("ny"), -F.col("x"))).alias("y"),
        F.max("height").alias("fontSize"), F.bool_or(F.col("fontFamily").rlike("(?i)mono|courier")).alias("mono"))
    return out.where("text <> ''").select(*PAGE, F.col("n").alias("lineSeq"), "text", "x", "y", "fontSize", "mono")


def pagination(lines: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documentId, pdfPage, printed) of pages that say their number, and (documentId, pageOffset, consistent, printedPageCount) of documents."""
    number = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in FOOTERS]).cast("int")
    total = F.coalesce(*[F.nullif(F.regexp_extract("text", p, 2), F.lit("")) for p in FOOTERS[:2]]).cast("int")
    said = relational.first_per_key(lines.where(F.col("y") < FOOTER_Y).withColumns({"printed": number, "total": total}).where("printed IS NOT NULL"), PAGE, ["lineSeq"]).select(*PAGE, "printed", "total")
    off = said.withColumn("off", F.col("pdfPage") - F.col("printed"))
    mode = relational.consensus(off, ["documentId"], "off", "pdfPage", out="pageOffset")
    facts = off.groupBy("documentId").agg((F.count_distinct("off") <= 1).alias("consistent"), F.coalesce(F.max("total"), F.count("*").cast("int")).alias("printedPageCount"))
    documents = pages.select("documentId").distinct().join(mode, "documentId", "left").join(facts, "documentId", "left")
    return said, documents.select("documentId", F.coalesce("pageOffset", F.lit(0)).alias("pageOffset"), F.coalesce("consistent", F.lit(True)).alias("consistent"), F.coalesce("printedPageCount", F.lit(0)).alias("printedPageCount"))


def printed_pages(rows: DataFrame, said: DataFrame, documents: DataFrame) -> DataFrame:
    """rows with printedPage: as said on the page, else by the document's offset; null before page 1."""
    shifted = F.col("pdfPage") - F.col("pageOffset")
    return rows.join(said.select(*PAGE, "printed"), PAGE, "left").join(documents.select("documentId", "pageOffset"), "documentId", "left").withColumn("printedPage", F.coalesce("printed", F.when(shifted >= 1, shifted)).cast("int")).drop("printed", "pageOffset")


def masked(c: Column) -> Column:
    return F.lower(squeezed(F.regexp_replace(c, r"\d+", "#")))


def band(y: Column) -> Column:
    return F.floor(y / BAND + 0.5)


def boilerplate(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(documentId, band, key, text): lines that repeat, digits aside, on most of a document's pages (empty ones count)."""
    totals = pages.groupBy("documentId").agg(F.count_distinct("pdfPage").alias("pages"))
    keyed = lines.withColumns({"key": masked(F.col("text")), "band": band(F.col("y"))})
    seen = keyed.groupBy("documentId", "band", "key").agg(F.count_distinct("pdfPage").alias("n"), F.min_by("text", F.struct("pdfPage", "lineSeq")).alias("text"))
    return seen.join(totals, "documentId").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(SHARE * F.col("pages")))).select("documentId", "band", "key", "text")


def subsequence(part: Column, whole: Column) -> Column:
    """Whether the words of part stand in whole in this order, with others between."""
    found = F.aggregate(whole, F.lit(0), lambda k, w: F.when(F.get(part, k) == w, k + 1).otherwise(k))
    return found == F.size(part)


#: Repeated lines are broadcast up to this many.
FEW_REPEATED = 100_000


def without_boilerplate(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """lines without repeated ones and shortened variants of them in the same band; redaction marks in one form.

    Repeated lines are few beside the lines: each is on most pages of its document. Up to FEW_REPEATED they
    go to where the lines are, so no band of a document meets in one task; more are of many documents.
    """
    repeated = relational.cut(repeated.select("documentId", "band", "key"))
    side = F.broadcast if repeated.count() <= FEW_REPEATED else (lambda df: df)
    own = lines.withColumns({"key": masked(F.col("text")), "band": band(F.col("y"))}).alias("own")
    rest = own.join(side(repeated), ["documentId", "band", "key"], "left_anti").alias("own")
    longer = side(repeated.select("documentId", "band", F.split("key", " ").alias("whole"))).alias("longer")
    words = F.split(F.col("own.key"), " ")
    same = (F.col("own.documentId") == F.col("longer.documentId")) & (F.col("own.band") == F.col("longer.band"))
    kept = rest.join(longer, same & (F.size(words) >= 2) & (F.size(words) < F.size("longer.whole")) & subsequence(words, F.col("longer.whole")), "left_anti").drop("key", "band")
    return kept.withColumn("text", F.when(F.trim("text").rlike(REDACTED), "[REDACTED]").otherwise(F.col("text")))


def reflowed(lines: Column) -> Column:
    """Lines as running text; a word broken by a hyphen at a line's end is made whole."""
    return squeezed(F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"([A-Za-z])-\n(?=[a-z])", "$1"), r"\n", " "))


def headings(lines: DataFrame) -> DataFrame:
    """lines with headingId and heading, null for other lines."""
    t = F.trim("text")
    numbered, appendix = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$", r"(?i)^(APPENDIX\s+\d+)\b[:.]?\s*(.*)$"
    fits = (F.col("fontSize") >= HEADING_SIZE) & ~F.col("mono") & F.length(t).between(3, 120)
    capitals = t.rlike(r"^[^a-z]*[A-Z][^a-z]*$") & (F.length(F.regexp_replace(t, "[^A-Z]", "")) >= 2)
    head = F.when(t.rlike(numbered), F.struct(F.regexp_extract(t, numbered, 1).alias("id"), F.regexp_extract(t, numbered, 2).alias("h")))
    head = head.when(t.rlike(appendix), F.struct(F.upper(F.regexp_replace(F.regexp_extract(t, appendix, 1), r"\s+", " ")).alias("id"), F.coalesce(F.nullif(F.regexp_extract(t, appendix, 2), F.lit("")), t).alias("h"))).when(capitals, F.struct(t.alias("id"), t.alias("h")))
    return lines.withColumn("_h", F.when(fits, head)).withColumns({"headingId": F.col("_h.id"), "heading": F.col("_h.h")}).drop("_h")


def structure(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, paragraphs): sections by running headings, paragraphs by gaps, pages and fonts.

    Paragraph thresholds use all lines of a page, headings too; a repeated section id takes the
    section's number behind a #. Lines meet once, by page: there they are cut into pieces, at headings and
    where a paragraph begins whatever came on earlier pages. A part is what a page has of one section.
    Segmented scans over pages and parts, which hold no text, give what is open where they begin; pieces
    then meet their part, and those of a paragraph each other.
    """
    page, number = Window.partitionBy(*PAGE).orderBy("lineSeq"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    marked = headings(lines).withColumns({"_gap": F.lag("y").over(page) - F.col("y"), "_heads": F.sum(F.col("headingId").isNotNull().cast("long")).over(page.rowsBetween(Window.unboundedPreceding, 0))})
    marked = marked.withColumn("_limit", PARAGRAPH * F.min(F.when(F.col("_gap") > 1, F.col("_gap"))).over(Window.partitionBy(*PAGE)))
    body = F.col("headingId").isNull()
    own = Window.partitionBy(*PAGE, "_heads", body).orderBy("lineSeq")
    before = F.lag(F.struct("mono", "y")).over(own)
    inner = before.isNotNull() & ((before["mono"] != F.col("mono")) | F.coalesce(before["y"] - F.col("y") > F.col("_limit"), F.lit(False)))
    marked = marked.withColumn("_inner", number(inner)).withColumn("_inner", F.sum("_inner").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.struct("mono", F.trim("text").rlike("[.:;]$").alias("ends"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("lineSeq", "text"))), lambda x: x["text"])
    pieces = stored([marked.groupBy(*PAGE, "_heads", body.alias("_body"), "_inner").agg(texts.alias("lines"), F.bool_and("mono").alias("code"), F.min_by("mono", "lineSeq").alias("mono"), F.max_by(end, "lineSeq").alias("end"), F.min("headingId").alias("id"), F.min("heading").alias("heading"))], "pieces")
    opened = scans.running(pieces.groupBy(*PAGE).agg(F.max("_heads").alias("heads")), ["documentId"], ["pdfPage"], sums=["heads"]).select(*PAGE, "before_heads")
    section = ["documentId", "sectionSeq"]
    placed = pieces.drop("lines").join(opened, PAGE).withColumn("sectionSeq", F.col("before_heads") + F.col("_heads")).drop("before_heads")
    placed = stored([placed], "placed")
    heads = placed.where("NOT _body").select(*section, "id", "heading", "pdfPage")
    front = placed.where("sectionSeq = 0").groupBy(*section).agg(F.lit("FRONT MATTER").alias("id"), F.lit("FRONT MATTER").alias("heading"), F.min("pdfPage").alias("pdfPage"))
    sections = front.unionByName(heads)
    first = sections.groupBy("documentId", "id").agg(F.min("sectionSeq").alias("_first"))
    sections = sections.join(first, ["documentId", "id"]).withColumn("id", F.when(F.col("sectionSeq") > F.col("_first"), F.concat("id", F.lit("#"), F.col("sectionSeq").cast("string"))).otherwise(F.col("id"))).drop("_first")
    parts = placed.where("_body").groupBy(*PAGE, "_heads", "sectionSeq").agg(F.max("_inner").alias("_inner"), F.min_by("mono", "_inner").alias("mono"), F.max_by("end", "_inner").alias("end"))
    parts = scans.running(parts, section, ["pdfPage"], lasts=["end"])
    last = F.col("last_end")
    parts = parts.withColumn("_new", number(last.isNull() | (last["mono"] != F.col("mono")) | last["ends"])).withColumn("begun", F.col("_new") + F.col("_inner"))
    begun = scans.running(parts.select(*PAGE, "_heads", "sectionSeq", "_new", "begun"), section, ["pdfPage"], sums=["begun"])
    begun = begun.join(sections.select(*section, F.col("id").alias("sectionId"), F.col("heading").alias("sectionHeading")), section).select(*PAGE, "_heads", "sectionSeq", "sectionId", "sectionHeading", (F.col("before_begun") + F.col("_new")).alias("_open"))
    paragraph = [*section, "sectionId", "sectionHeading", "paraSeq"]
    held = pieces.where("_body").select(*PAGE, "_heads", "_inner", "lines", "code").join(begun, [*PAGE, "_heads"]).withColumn("paraSeq", F.col("_open") + F.col("_inner"))
    listed = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pdfPage", "lines"))), lambda x: x["lines"]))  # a paragraph has a piece a page
    paragraphs = held.groupBy(*paragraph).agg(listed.alias("lines"), F.min("pdfPage").alias("pdfPage"), F.when(F.bool_and("code"), "CODE").otherwise("PROSE").alias("kind"))
    paragraphs = paragraphs.withColumn("text", F.when(F.col("kind") == "CODE", F.array_join("lines", "\n")).otherwise(reflowed(F.col("lines"))))
    return sections, paragraphs.withColumn("paragraphId", F.concat("sectionId", F.lit("-p"), F.col("paraSeq").cast("string")))


def abbreviations(paragraphs: DataFrame) -> DataFrame:
    """(documentId, abbrSeq, acronym, expansion, paragraphId) from sections of abbreviations."""
    row = r"^(\S{1,8})\s+(\S.{3,})$"
    lines = paragraphs.where(F.col("sectionHeading").rlike("(?i)ABBREVIATION|DEFINITION OF TERMS")).select("documentId", "sectionSeq", "paraSeq", "paragraphId", F.posexplode("lines").alias("k", "line"))
    token = F.regexp_extract("line", row, 1)
    capitals = F.regexp_count(token, F.lit("[A-Z]"))
    looks = ((capitals >= 2) | ((capitals == 1) & (F.length(token) <= 4))) & ~F.lower(token).isin("table", "figure", "list", "page")
    found = lines.where(F.col("line").rlike(row) & looks).select("*", token.alias("acronym"), F.trim(F.regexp_extract("line", row, 2)).alias("expansion"))
    return scans.numbered_within(found, "documentId", ["sectionSeq", "paraSeq", "k"], "abbrSeq").withColumn("abbrSeq", F.col("abbrSeq").cast("int")).select("documentId", "abbrSeq", "acronym", "expansion", "paragraphId")


def index_of(paragraphs: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Paragraphs with their documents' columns and order (documents by the descriptors' order)."""
    d = descriptors.select(F.col("id").alias("documentId"), F.col("type").alias("documentType"), F.col("title").alias("documentTitle"), "version", "author", "docSeq")
    return paragraphs.join(d, "documentId").select("documentId", "documentType", "documentTitle", "version", "author", "sectionId", "sectionHeading", "paragraphId", "printedPage", "pdfPage", "text", "lines", "kind", "docSeq", "sectionSeq", "paraSeq")


def ingest(items: DataFrame, descriptors: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the documents: paragraphs, sections, abbreviations, documents.

    pages: (documentId, pdfPage), with pages that have no items; else the pages that items are on.
    """
    pages = items.select(*PAGE).distinct() if pages is None else pages
    lines = stored([lines_of(upright(items))], "lines")
    said, offsets = pagination(lines, pages)
    repeated = boilerplate(lines, pages)
    kept = stored([without_boilerplate(lines, repeated)], "kept")
    sections, paragraphs = structure(kept)
    paragraphs = printed_pages(paragraphs, said, offsets)
    counts = pages.groupBy("documentId").agg(F.count_distinct("pdfPage").alias("pdfPageCount"))
    listed = repeated.groupBy("documentId").agg(F.array_sort(F.collect_list("text")).alias("boilerplate"))
    documents = descriptors.withColumnRenamed("id", "documentId").withColumnRenamed("type", "documentType").join(counts, "documentId", "left").join(offsets, "documentId", "left").join(listed, "documentId", "left").join(rotated_dropped(items), "documentId", "left")
    removed = lines.groupBy("documentId").agg(F.count("*").alias("_all")).join(kept.groupBy("documentId").agg(F.count("*").alias("_kept")), "documentId", "left")
    documents = documents.join(removed.select("documentId", (F.col("_all") - F.coalesce("_kept", F.lit(0))).alias("linesRemoved")), "documentId", "left")
    return {"paragraphs": index_of(paragraphs, descriptors), "sections": printed_pages(sections, said, offsets), "abbreviations": abbreviations(paragraphs), "documents": documents, "lines": lines}
