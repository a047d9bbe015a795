"""Authored blocks laid out on pages by Spark: the pages of fixtures.item_rows for any number of documents, of any length.

A page is filled by a running sum that starts anew wherever a line does not fit; where that happens
depends on where the page before began. A document's lines are dealt into ranges of RANGE lines. For
each line that may be the first new page of a range (a page has per_page lines at most, so one of the
first per_page) the range is walked once: that gives the range's pages, and the line at which the first
page of the next range begins. These steps from range to range are composed by doubling, from the
document's first line; then each range is walked once more, from the line that was found. No task holds
a document, only ranges.

All lengths are hundredths of a point, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veritab.operators import relational, scans
from veritab.plans.scratch import stored
from veritab.sources import fixtures as G

RANGE = 512
#: kind of a block: its font, size, step from line to line, room before and after the block.
SHAPES = {
    "heading": ("Helvetica-Bold", G.HEADING, 1.6 * G.LEADING, G.LEADING, 0.0),
    "code": ("Courier", G.CODE, G.CODE_LEADING, 0.0, G.LEADING),
    "table": ("Times", G.BODY, G.LEADING, 0.0, G.LEADING),
    "bullets": ("Times", G.BODY, G.LEADING, 0.0, G.LEADING),
    "redaction": ("Times", G.BODY, G.LEADING, 0.0, G.LEADING),
}
PARA = ("Times", G.BODY, G.LEADING, 0.0, G.LEADING)
BLOCKS = "documentId string, blockSeq int, kind string, text string, rows array<string>"


def _of(kind: Column, at: int, whole: bool = False) -> Column:
    value = lambda s: F.lit(G.hundredths(s[at]) if whole else s[at])
    out = value(PARA)
    for name, shape in SHAPES.items():
        out = F.when(kind == name, value(shape)).otherwise(out)
    return out


def wrapped(text: Column, width: int = G.WIDTH) -> Column:
    """Text as lines of whole words; a word longer than a line has one of its own. A line is the longest match from its first word on that ends with a word."""
    words = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.regexp_extract_all(words, F.lit(rf"(?s)[^ ].{{0,{width - 1}}}(?= |\z)|[^ ]+"), F.lit(0))


def lines_of(blocks: DataFrame) -> DataFrame:
    """(documentId, lineNo, text, size, fontFamily, gap, step) of blocks; lines are numbered from 0 in a document.

    A block without lines takes no room. A null text or list is an empty one, a null kind is a paragraph.
    """
    kind, text, rows = F.coalesce("kind", F.lit("para")), F.coalesce("text", F.lit("")), F.filter(F.coalesce("rows", F.array().cast("array<string>")), lambda x: x.isNotNull())
    titled = F.concat(F.when(text != "", F.array(text)).otherwise(F.array().cast("array<string>")), rows)
    own = (
        F.when(kind == "heading", F.array(text)).when(kind == "code", rows).when(kind == "table", titled)
        .when(kind == "bullets", F.transform(titled, lambda x: F.concat(F.lit("- "), x))).otherwise(wrapped(F.when(kind == "redaction", F.lit("PPD")).otherwise(text)))
    )
    # Behind an explode the folds over words are not repeated for what is made of their lines.
    laid = blocks.select("documentId", "blockSeq", kind.alias("kind"), F.explode(F.array(own)).alias("own")).withColumn("n", F.size("own").cast("long")).where("n > 0").withColumn("tail", _of(F.col("kind"), 4, True))
    placed = scans.running(laid, ["documentId"], ["blockSeq"], sums=["n"], lasts=["tail"])
    each = placed.select("documentId", "kind", F.col("before_n").alias("_first"), (F.coalesce("last_tail", F.lit(0)) + _of(F.col("kind"), 3, True)).alias("_gap"), F.posexplode("own").alias("_i", "text"))
    return each.select("documentId", (F.col("_first") + F.col("_i")).alias("lineNo"), "text", _of(F.col("kind"), 1).alias("size"), _of(F.col("kind"), 0).alias("fontFamily"), F.when(F.col("_i") == 0, F.col("_gap")).otherwise(0).cast("long").alias("gap"), _of(F.col("kind"), 2, True).cast("long").alias("step"))


def _walked(lines: Column, entry: Column, end: Column, per_page: int) -> Column:
    """(starts, exit): the page starts from entry to before end, and the first one from end on (null if there is none)."""
    room = G.hundredths(G.TOP) - G.hundredths(G.BOTTOM)
    start = F.struct(F.array().cast("array<bigint>").alias("starts"), F.lit(None).cast("bigint").alias("exit"), F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("n"))

    def step(a: Column, x: Column) -> Column:
        begins = (x["no"] == entry) | (a["used"] + x["gap"] + x["step"] > room) | (a["n"] >= per_page)
        grown = lambda starts, out, used, n: F.struct(starts.alias("starts"), out.alias("exit"), used.cast("bigint").alias("used"), n.cast("bigint").alias("n"))
        new = grown(F.concat(a["starts"], F.array(x["no"])), a["exit"], x["step"] + F.when(x["no"] == 0, x["gap"]).otherwise(0), F.lit(1))
        return F.when((x["no"] < entry) | a["exit"].isNotNull(), a).when(begins & (x["no"] >= end), grown(a["starts"], x["no"], a["used"], a["n"])).when(begins, new).otherwise(grown(a["starts"], a["exit"], a["used"] + x["gap"] + x["step"], a["n"] + 1))

    return F.aggregate(lines, start, step, lambda a: F.struct(a["starts"].alias("starts"), a["exit"].alias("exit")))


def pages_of(lines: DataFrame, per_page: int = 50, range_lines: int = RANGE) -> DataFrame:
    """lines with page (from 1) and y, in hundredths of a point."""
    if range_lines < per_page:
        raise ValueError("a range has at least the lines of a page")
    lines = relational.cut(lines.withColumn("range", F.floor(F.col("lineNo") / range_lines)))
    ahead = lines.where((F.col("range") > 0) & (F.col("lineNo") % range_lines < per_page)).withColumn("range", F.col("range") - 1)
    held = lines.unionByName(ahead).groupBy("documentId", "range").agg(F.array_sort(F.collect_list(F.struct(F.col("lineNo").alias("no"), "gap", "step"))).alias("lines"))  # range_lines + per_page at most
    end = (F.col("range") + 1) * range_lines
    ranges = relational.cut(held.withColumn("end", end))
    last = ranges.agg(F.max("range")).first()[0] or 0
    reached = ranges.where("range = 0").select("documentId", "range", F.lit(0).cast("bigint").alias("entry"), F.lit(0).cast("bigint").alias("pages"))
    if last:
        several = ranges.join(ranges.where("range = 1").select("documentId"), "documentId", "left_semi")  # others need no steps
        first = F.when(F.col("range") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(F.filter("lines", lambda x: x["no"] < F.col("range") * range_lines + per_page), lambda x: x["no"]))
        steps = several.withColumn("entry", F.explode(first)).withColumn("w", _walked(F.col("lines"), F.col("entry"), F.col("end"), per_page))
        steps = relational.cut(steps.select("documentId", "range", "entry", F.col("w.exit").alias("exit"), F.size("w.starts").cast("bigint").alias("pages")))
        reached, far = relational.cut(reached), 1
        while far <= last:
            more = reached.join(steps.withColumnRenamed("pages", "_p"), ["documentId", "range", "entry"]).where("exit IS NOT NULL")
            reached = relational.cut(reached.unionByName(more.select("documentId", (F.col("range") + far).alias("range"), F.col("exit").alias("entry"), (F.col("pages") + F.col("_p")).alias("pages"))))
            then = steps.select("documentId", (F.col("range") - far).alias("range"), F.col("entry").alias("exit"), F.col("exit").alias("_exit"), F.col("pages").alias("_p"))
            far *= 2
            if far <= last:
                steps = relational.cut(steps.join(then, ["documentId", "range", "exit"]).select("documentId", "range", "entry", F.col("_exit").alias("exit"), (F.col("pages") + F.col("_p")).alias("pages")))
    walked = ranges.join(reached, ["documentId", "range"], "left")
    starts = walked.select("documentId", "range", "pages", F.when(F.col("entry").isNotNull(), _walked(F.col("lines"), F.col("entry"), F.col("end"), per_page)["starts"]).otherwise(F.array().cast("array<bigint>")).alias("starts"))
    starts = relational.cut(starts)
    # A document's last range may lie whole on a page that began before it.
    past = starts.select("documentId", (F.col("range") + 1).alias("range"), (F.col("pages") + F.size("starts")).alias("_past"))
    starts = starts.join(past, ["documentId", "range"], "left").withColumn("pages", F.coalesce("pages", "_past")).drop("_past")
    numbered = lines.join(starts, ["documentId", "range"]).withColumn("page", (F.col("pages") + F.size(F.filter("starts", lambda s: s <= F.col("lineNo")))).cast("int"))
    page = Window.partitionBy("documentId", "page").orderBy("lineNo")  # per_page lines at most
    first = F.row_number().over(page) == 1
    gap = F.when(first & (F.col("lineNo") > 0), 0).otherwise(F.col("gap"))
    down = F.sum(gap + F.col("step")).over(page) - F.col("step")
    return numbered.withColumn("y", G.hundredths(G.TOP) - down).drop("range", "pages", "starts", "gap", "step")


def corpus(documents: DataFrame, blocks: DataFrame, per_page: int = 50, range_lines: int = RANGE, watermark: str = "DRAFT") -> dict[str, DataFrame]:
    """items, descriptors and page_map of documents (DESCRIPTORS, docSeq, header, leaves) and their blocks (BLOCKS).

    A document without lines has one page beside its unnumbered leaves. Blocks of unknown documents are
    left out; a null or empty header is the title.
    """
    known = documents.withColumn("documentId", F.col("id")).withColumn("header", F.coalesce(F.nullif(F.col("header"), F.lit("")), F.col("title"), F.lit(""))).withColumn("leaves", F.coalesce(F.col("leaves"), F.lit(1)).cast("int"))
    head = relational.cut(known.select("documentId", "type", "version", "fileName", "header", "leaves"))
    # Texts are stored once, as Parquet; pages are filled from numbers alone.
    lines = stored([lines_of(blocks.join(head.select("documentId"), "documentId", "left_semi"))], "lines")
    filled = relational.cut(pages_of(lines.select("documentId", "lineNo", "gap", "step"), per_page, range_lines))
    totals = relational.cut(head.join(filled.groupBy("documentId").agg(F.max("page").alias("total"), F.count("*").alias("lines")), "documentId", "left").withColumn("total", F.coalesce("total", F.lit(1))))
    first = F.row_number().over(Window.partitionBy("documentId", "page").orderBy("lineNo")) - 1
    at = relational.looked_up(filled.withColumn("itemSeq", first), totals.select("documentId", "leaves"), "documentId").withColumn("pdfPage", F.col("page") + F.col("leaves"))
    item = lambda page, seq, text, x, y, size, turn, font: (F.col("documentId"), page.cast("int").alias("pdfPage"), seq.cast("int").alias("itemSeq"), text.alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), (0.5 * size * F.length(text)).alias("width"), size.cast("double").alias("height"), F.lit(turn).alias("rotation"), font.alias("fontFamily"))
    body = at.join(lines.select("documentId", "lineNo", "text", "size", "fontFamily"), ["documentId", "lineNo"]).select(*item(F.col("pdfPage"), F.col("itemSeq"), F.col("text"), F.lit(G.LEFT), F.col("y") / 100, F.col("size"), 0, F.col("fontFamily")))
    sheets = totals.withColumn("pdfPage", F.explode(F.sequence(F.lit(1), F.col("leaves") + F.col("total")))).withColumn("number", F.col("pdfPage") - F.col("leaves"))
    counts = at.groupBy("documentId", "pdfPage").agg(F.count("*").alias("n"))
    sheets = sheets.join(counts, ["documentId", "pdfPage"], "left").withColumn("n", F.when(F.col("number") < 1, 1).otherwise(F.coalesce("n", F.lit(0))))
    number = F.col("number").cast("string")
    footer = F.when(F.col("number") >= 1, F.concat(F.lit("Confidential Page "), number, F.lit(" of "), F.col("total").cast("string"))).otherwise("Confidential Page")
    leaf = F.concat("header", F.lit(" front leaf "), F.col("pdfPage").cast("string"))
    marks = [(F.col("header"), G.LEFT, G.HEADER_Y, G.SMALL, 0, "Times"), (footer, G.LEFT, G.FOOTER_Y, G.SMALL, 0, "Times"), (F.lit(watermark), 200.0, 400.0, 60.0, 38, "Helvetica"), (F.lit("Approved"), 580.0, 300.0, G.SMALL, 90, "Helvetica")]
    items = body.unionByName(sheets.where("number < 1").select(*item(F.col("pdfPage"), F.lit(0), leaf, F.lit(G.LEFT), F.lit(G.TOP), F.lit(G.BODY), 0, F.lit("Times"))))
    for i, (text, x, y, size, turn, font) in enumerate(marks):
        items = items.unionByName(sheets.select(*item(F.col("pdfPage"), F.col("n") + i, text, F.lit(x), F.lit(y), F.lit(size), turn, F.lit(font))))
    page_map = totals.select("documentId", "type", "version", F.col("fileName").alias("file"), (F.col("total") + F.col("leaves")).cast("int").alias("pdfPages"), F.col("total").cast("int").alias("printedPages"), F.col("leaves").alias("pageOffset"))
    return {"items": items, "descriptors": documents.select("id", "type", "fileName", "title", "version", "effectiveDate", "author", "docSeq"), "page_map": page_map}
