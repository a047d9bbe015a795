"""Ingest, scalar functions and review over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.model import DOCUMENT_TYPES, SEVERITIES
from veritab.operators import ingest, matrix, relational, review
from veritab.plans.queries import query, t
from veritab.plans.scratch import stored

TYPES = "['" + "','".join(DOCUMENT_TYPES) + "']"
#: A document's line at place pos of its page, with headings and marks put in between; both dialects read it.
LINE = """CASE WHEN pos % 18 = 0 THEN concat(CAST(doc_id % 7 + 1 AS STRING), '.', CAST(pos % 5 AS STRING), ' Heading of ', source) WHEN pos % 18 = 6 THEN concat('Appendix ', CAST(doc_id % 9 AS STRING), ': Names') WHEN pos % 18 = 12 THEN 'LIST OF ABBREVIATIONS'
 WHEN pos % 18 IN (13, 14) THEN concat('AB', CAST(doc_id % 100 AS STRING), ' meaning number ', CAST(pos AS STRING)) WHEN pos % 13 = 12 THEN 'CCI' ELSE line END"""
Y = "780D - 12D * pos - 7D * CAST(floor(pos / 4) AS DOUBLE)"
HEADER = "CASE WHEN doc_id % 7 = 0 THEN concat('Report page ', CAST(doc_id AS STRING)) ELSE concat('Report of ', source, ' page ', CAST(doc_id AS STRING)) END"


def lines(spark, sf) -> DataFrame:
    """Documents as pages of their sources, a row a line, with a header each and a footer on most."""
    docs = t(spark, sf, "documents").select("doc_id", "source", "text")
    body = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", "source", "pos", F.expr(LINE).alias("text"), F.expr(Y).alias("y"))
    head = docs.select("doc_id", "source", F.lit(-2).alias("pos"), F.expr(HEADER).alias("text"), F.lit(800.0).alias("y"))
    foot = docs.where("doc_id % 3 <> 0").select("doc_id", "source", F.lit(-1).alias("pos"), F.expr("concat('Page ', CAST(doc_id DIV 4 AS STRING), ' of 900')").alias("text"), F.lit(52.0).alias("y"))
    return body.union(head).union(foot).where("trim(text) <> ''").select(
        F.col("source").alias("documentId"), F.col("doc_id").cast("int").alias("pdfPage"), (F.col("pos") + 3).alias("lineSeq"), "text", F.lit(68.0).alias("x"), "y", F.when(F.col("pos") % 6 == 0, 10.5).otherwise(9.5).alias("fontSize"), (F.col("pos") % 9 == 8).alias("mono"))


def pages(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select(F.col("source").alias("documentId"), F.col("doc_id").cast("int").alias("pdfPage"))


LINES = f"""d AS (SELECT doc_id, source, text FROM documents), b0 AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM d),
l0 AS (SELECT doc_id, source, pos, {LINE} AS text, 78e1 - 12e0 * pos - 7e0 * (pos // 4) AS y FROM b0 UNION ALL SELECT doc_id, source, -2, {HEADER}, 8e2 FROM d UNION ALL SELECT doc_id, source, -1, 'Page ' || (doc_id // 4) || ' of 900', 52e0 FROM d WHERE doc_id % 3 <> 0),
l AS (SELECT source AS doc, CAST(doc_id AS INTEGER) AS page, CAST(pos + 3 AS INTEGER) AS n, text, y, CASE WHEN pos % 6 = 0 THEN 105e-1 ELSE 95e-1 END AS size, pos % 9 = 8 AS mono FROM l0 WHERE trim(text) <> '')"""
WS = "[ \\t\\n\\r\\f\\x0B\\x{00A0}]+"
KEYED = f"""k AS (SELECT *, CAST(floor(y / 6e0 + 5e-1) AS BIGINT) AS band, lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '{WS}', ' ', 'g'))) AS key FROM l),
totals AS (SELECT source AS doc, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1),
rep AS (SELECT doc, band, key, arg_min(text, (page, n)) AS text FROM k JOIN totals USING (doc) GROUP BY doc, band, key, pages HAVING count(DISTINCT page) >= greatest(2, ceil(6e-1 * pages)))"""
CLEAN = """kept AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM rep r WHERE r.doc = k.doc AND r.band = k.band AND r.key = k.key)
  AND NOT (band = 133 AND EXISTS (SELECT 1 FROM rep r WHERE r.doc = k.doc AND r.band = 133 AND len(string_split(k.key, ' ')) BETWEEN 2 AND len(string_split(r.key, ' ')) - 1 AND CASE WHEN k.band = 133 THEN regexp_matches(r.key, '(^| )' || array_to_string(list_transform(string_split(k.key, ' '), lambda w: regexp_escape(w)), ' (.* )?') || '( |$)') ELSE false END))),
c AS (SELECT * REPLACE (CASE WHEN regexp_full_match(trim(text), 'PPD|CCI|REDACTED|X{3,}') THEN '[REDACTED]' ELSE text END AS text) FROM kept)"""


@query(f"WITH {LINES}, {KEYED} SELECT doc AS document, band, key, text FROM rep")
def repeated_lines(spark, sf):
    """Lines that repeat on most pages of a document."""
    return ingest.boilerplate(lines(spark, sf), pages(spark, sf)).select(F.col("documentId").alias("document"), "band", "key", "text")


def _clean(spark, sf) -> DataFrame:
    own = stored([lines(spark, sf)], "lines")
    return ingest.without_boilerplate(own, ingest.boilerplate(own, pages(spark, sf)))


@query(f"WITH {LINES}, {KEYED}, {CLEAN} SELECT doc AS document, page, count(*) AS lines, count(*) FILTER (text = '[REDACTED]') AS redacted, max(n) AS last FROM c GROUP BY ALL")
def clean_lines(spark, sf):
    """What is left of each page without repeated lines and shortened forms of them."""
    return _clean(spark, sf).groupBy(F.col("documentId").alias("document"), F.col("pdfPage").alias("page")).agg(F.count("*").alias("lines"), F.count_if(F.col("text") == "[REDACTED]").alias("redacted"), F.max("lineSeq").alias("last"))


NUMBERED, APPENDIX = "^([0-9]+(?:\\.[0-9]+)*)\\.?\\s+(\\S.*)$", "(?i)^(APPENDIX\\s+[0-9]+)\\b[:.]?\\s*(.*)$"
HEADS = f"""h0 AS (SELECT *, trim(text) AS t FROM c), h AS (SELECT *, CASE WHEN size >= 99e-1 AND NOT mono AND length(t) BETWEEN 3 AND 120 THEN CASE WHEN regexp_matches(t, '{NUMBERED}') THEN regexp_extract(t, '{NUMBERED}', 1) WHEN regexp_matches(t, '{APPENDIX}') THEN upper(regexp_replace(regexp_extract(t, '{APPENDIX}', 1), '\\s+', ' ', 'g'))
  WHEN regexp_matches(t, '^[^a-z]*[A-Z][^a-z]*$') AND length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 2 THEN t END END AS hid,
  CASE WHEN regexp_matches(t, '{NUMBERED}') THEN regexp_extract(t, '{NUMBERED}', 2) WHEN regexp_matches(t, '{APPENDIX}') THEN coalesce(nullif(regexp_extract(t, '{APPENDIX}', 2), ''), t) ELSE t END AS head FROM h0)"""


@query(f"WITH {LINES}, {KEYED}, {CLEAN}, {HEADS} SELECT doc AS document, page, n AS line, hid AS id, head AS heading FROM h WHERE hid IS NOT NULL")
def headings(spark, sf):
    """Lines that head sections: numbered, appendices, capitals."""
    return ingest.headings(_clean(spark, sf)).where("headingId IS NOT NULL").select(F.col("documentId").alias("document"), F.col("pdfPage").alias("page"), F.col("lineSeq").alias("line"), F.col("headingId").alias("id"), "heading")


STRUCTURE = """g AS (SELECT *, lag(y) OVER (PARTITION BY doc, page ORDER BY n) - y AS gap FROM h), lim AS (SELECT doc, page, 128e-2 * min(gap) FILTER (gap > 1) AS lim FROM g GROUP BY ALL),
s0 AS (SELECT g.*, lim, sum(CASE WHEN hid IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS sec FROM g JOIN lim USING (doc, page)),
sections0 AS (SELECT doc, sec, hid AS id, head, page FROM s0 WHERE hid IS NOT NULL UNION ALL SELECT doc, 0, 'FRONT MATTER', 'FRONT MATTER', min(page) FROM s0 WHERE sec = 0 GROUP BY doc),
sections AS (SELECT doc, sec, CASE WHEN row_number() OVER (PARTITION BY doc, id ORDER BY sec) > 1 THEN id || '#' || sec ELSE id END AS id, head, page FROM sections0),
p0 AS (SELECT *, lag(page) OVER w AS bp, lag(mono) OVER w AS bm, lag(y) OVER w AS by_, lag(text) OVER w AS bt FROM s0 WHERE hid IS NULL WINDOW w AS (PARTITION BY doc, sec ORDER BY page, n)),
p1 AS (SELECT *, sum(CASE WHEN bp IS NULL OR bm <> mono OR (bp = page AND coalesce(by_ - y > lim, false)) OR (bp <> page AND regexp_matches(trim(bt), '[.:;]$')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, sec ORDER BY page, n ROWS UNBOUNDED PRECEDING) AS para FROM p0),
p AS (SELECT doc, sec, para, list(text ORDER BY page, n) AS lines, min(page) AS page, CASE WHEN bool_and(mono) THEN 'CODE' ELSE 'PROSE' END AS kind FROM p1 GROUP BY ALL)"""
REFLOW = "trim(regexp_replace(regexp_replace(regexp_replace(array_to_string(lines, chr(10)), '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g'), '\\n', ' ', 'g'), '" + WS + "', ' ', 'g'))"


@query(f"WITH {LINES}, {KEYED}, {CLEAN}, {HEADS}, {STRUCTURE} SELECT doc AS document, CAST(sec AS BIGINT) AS section, id, head AS heading, page FROM sections")
def sections(spark, sf):
    """Sections by running headings, repeated ids told apart."""
    own, _ = ingest.structure(_clean(spark, sf))
    return own.select(F.col("documentId").alias("document"), F.col("sectionSeq").cast("long").alias("section"), "id", "heading", F.col("pdfPage").alias("page"))


@query(f"WITH {LINES}, {KEYED}, {CLEAN}, {HEADS}, {STRUCTURE} SELECT doc AS document, CAST(sec AS BIGINT) AS section, CAST(para AS BIGINT) AS paragraph, s.id || '-p' || para AS id, p.page, kind, len(lines) AS lines, CASE kind WHEN 'CODE' THEN array_to_string(lines, chr(10)) ELSE {REFLOW} END AS text FROM p JOIN sections s USING (doc, sec)")
def paragraphs_of_lines(spark, sf):
    """Paragraphs by gaps, pages and fonts, as running text or as code."""
    _, own = ingest.structure(_clean(spark, sf))
    return own.select(F.col("documentId").alias("document"), F.col("sectionSeq").cast("long").alias("section"), F.col("paraSeq").cast("long").alias("paragraph"), F.col("paragraphId").alias("id"), F.col("pdfPage").alias("page"), "kind", F.size("lines").cast("long").alias("lines"), "text")


ROW = "^(\\S{1,8})\\s+(\\S.{3,})$"


@query(f"""WITH {LINES}, {KEYED}, {CLEAN}, {HEADS}, {STRUCTURE}, a AS (SELECT doc, sec, para, s.id || '-p' || para AS pid, unnest(lines) AS line, unnest(range(0, len(lines))) AS k FROM p JOIN sections s USING (doc, sec) WHERE regexp_matches(s.head, '(?i)ABBREVIATION|DEFINITION OF TERMS')),
x AS (SELECT *, regexp_extract(line, '{ROW}', 1) AS acr, length(regexp_replace(regexp_extract(line, '{ROW}', 1), '[^A-Z]', '', 'g')) AS caps FROM a WHERE regexp_matches(line, '{ROW}'))
SELECT doc AS document, row_number() OVER (PARTITION BY doc ORDER BY sec, para, k) AS seq, acr AS acronym, trim(regexp_extract(line, '{ROW}', 2)) AS expansion, pid AS paragraph FROM x WHERE (caps >= 2 OR (caps = 1 AND length(acr) <= 4)) AND lower(acr) NOT IN ('table', 'figure', 'list', 'page')""")
def abbreviation_table(spark, sf):
    """Rows of the sections of abbreviations."""
    _, own = ingest.structure(_clean(spark, sf))
    return ingest.abbreviations(own).select(F.col("documentId").alias("document"), F.col("abbrSeq").cast("long").alias("seq"), "acronym", "expansion", F.col("paragraphId").alias("paragraph"))


@query(f"""WITH {LINES}, s AS (SELECT doc, page, arg_min(CAST(regexp_extract(text, '(?i)page\\s+([0-9]+)\\s+of\\s+([0-9]+)', 1) AS INTEGER), n) AS printed FROM l WHERE y < 110 AND regexp_matches(text, '(?i)page\\s+[0-9]+\\s+of\\s+[0-9]+') GROUP BY ALL),
o AS (SELECT doc, page - printed AS off, count(*) AS c, min(page) AS s FROM s GROUP BY ALL), m AS (SELECT doc, off FROM o QUALIFY row_number() OVER (PARTITION BY doc ORDER BY c DESC, s) = 1)
SELECT doc AS document, off AS "offset", (SELECT count(*) = 1 FROM o WHERE o.doc = m.doc) AS consistent, 900 AS printed FROM m""")
def paginations(spark, sf):
    """How documents number their pages, by their footers."""
    _, documents = ingest.pagination(lines(spark, sf), pages(spark, sf))
    return documents.select(F.col("documentId").alias("document"), F.col("pageOffset").alias("offset"), "consistent", F.col("printedPageCount").alias("printed"))


@query(f"""WITH {LINES}, {KEYED}, {CLEAN}, {HEADS}, {STRUCTURE}, o AS (SELECT source AS doc, row_number() OVER (ORDER BY source) - 1 AS k FROM (SELECT DISTINCT source FROM documents))
SELECT {TYPES}[CAST(k % 5 AS INTEGER) + 1] AS type, k AS "order", count(*) AS paragraphs, max(len(lines)) AS longest FROM p JOIN o USING (doc) GROUP BY ALL""")
def indexed_paragraphs(spark, sf):
    """Paragraphs with the columns and the order of their documents."""
    _, own = ingest.structure(_clean(spark, sf))
    names = t(spark, sf, "documents").select("source").distinct()
    listed = relational.dense_numbers(names, ["source"], "docSeq").withColumn("docSeq", F.col("docSeq") - 1)
    descriptors = listed.select(F.col("source").alias("id"), F.get(F.array(*[F.lit(x) for x in DOCUMENT_TYPES]), F.col("docSeq") % 5).alias("type"), F.lit("").alias("title"), F.lit("v1").alias("version"), F.lit("").alias("author"), "docSeq")
    out = ingest.index_of(own.withColumn("printedPage", F.col("pdfPage")), descriptors)
    return out.groupBy(F.col("documentType").alias("type"), F.col("docSeq").cast("long").alias("order")).agg(F.count("*").alias("paragraphs"), F.max(F.size("lines")).cast("long").alias("longest"))


def items(spark, sf) -> DataFrame:
    """Events as positioned items: pages are users, places follow from values."""
    return t(spark, sf, "events").where("value IS NOT NULL").select(
        F.lit("D").alias("documentId"), F.col("user_id").cast("int").alias("pdfPage"), F.col("event_id").cast("int").alias("itemSeq"), F.col("event_type").alias("text"), F.expr("CAST(event_id % 7 AS DOUBLE) * 12D").alias("x"), F.expr("CAST(CAST(floor(value * 4D) AS INT) AS DOUBLE) / 2D").alias("y"),
        F.lit(11.0).alias("width"), F.expr("8D + CAST(event_id % 3 AS DOUBLE)").alias("height"), F.expr("CAST(CASE event_id % 10 WHEN 0 THEN 90 WHEN 1 THEN -2 ELSE 0 END AS INT)").alias("rotation"), F.expr("CASE WHEN event_id % 6 = 0 THEN 'Courier' ELSE 'Times' END").alias("fontFamily"))


ITEMS = "i0 AS (SELECT user_id AS page, event_id AS seq, event_type AS text, (event_id % 7) * 12e0 AS x, floor(value * 4) / 2e0 AS y, 11e0 AS width, 8e0 + event_id % 3 AS height, CASE event_id % 10 WHEN 0 THEN 90 WHEN 1 THEN -2 ELSE 0 END AS rotation, event_id % 6 = 0 AS mono FROM events WHERE value IS NOT NULL)"


@query(f"WITH {ITEMS} SELECT count(*) FILTER (abs(rotation) > 3) AS dropped, count(*) FILTER (abs(rotation) <= 3) AS upright FROM i0")
def rotated_items(spark, sf):
    """Items that lie on their side, which are left out."""
    own = items(spark, sf)
    return ingest.rotated_dropped(own).select(F.col("rotatedItemsDropped").alias("dropped")).crossJoin(ingest.upright(own).agg(F.count("*").alias("upright")))  # single rows


@query(f"""WITH RECURSIVE {ITEMS}, i AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY -y, x, seq) AS k FROM i0 WHERE abs(rotation) <= 3),
b AS (SELECT page, k, -y AS anchor, 1 AS line FROM i WHERE k = 1 UNION ALL SELECT i.page, i.k, CASE WHEN -i.y > b.anchor + 22e-1 THEN -i.y ELSE b.anchor END, CASE WHEN -i.y > b.anchor + 22e-1 THEN b.line + 1 ELSE b.line END FROM b JOIN i ON i.page = b.page AND i.k = b.k + 1),
m AS (SELECT i.*, line, CASE WHEN x - lag(x + width) OVER w > greatest(12e-1, 22e-2 * height) THEN ' ' ELSE '' END || text AS piece FROM i JOIN b USING (page, k) WINDOW w AS (PARTITION BY page, line ORDER BY x, seq))
SELECT page, line, trim(string_agg(piece, '' ORDER BY x, seq)) AS text, min(x) AS x, max(y) AS y, max(height) AS size, bool_or(mono) AS mono FROM m GROUP BY ALL""")
def lines_of_items(spark, sf):
    """Items put together to lines, with blanks where they stand apart."""
    out = ingest.lines_of(ingest.upright(items(spark, sf)))
    return out.select(F.col("pdfPage").cast("long").alias("page"), F.col("lineSeq").alias("line"), "text", "x", "y", F.col("fontSize").alias("size"), "mono")


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 2 WHEN 1 THEN '.5' ELSE '' END AS number, 'CTCAE ' || p_size || '.0' AS version, 'Cycle ' || p_size || ' Day 8' AS label, lower(p_brand) AS term, CASE p_partkey % 3 WHEN 0 THEN '0-' || (p_size % 5 + 1) WHEN 1 THEN CAST(p_size % 6 AS VARCHAR) END AS grades, p_partkey % 2 = 0 AS contained,
p_type || ' v1 §' || p_brand || ', ' || CASE WHEN p_partkey % 4 = 0 THEN 'front matter, PDF p. 9' ELSE 'p. ' || p_size || ' (PDF p. 9)' END AS citation, left(p_name, 2) || '|' || substr(p_name, 3, 2) || '|' || substr(p_name, 5) AS excerpt, least(16e-2, 5e-2 + 25e-3 * (p_size % 9)) AS shade,
CASE WHEN length(p_name) > 6 THEN left(p_name, 5) || '…' ELSE p_name END AS short, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' and ' || p_brand ELSE p_type || ', ' || p_brand || ' and x' END AS listed, p_partkey % 2 AS decimals, CASE p_partkey % 3 WHEN 0 THEN 'ONE-SIDED' WHEN 1 THEN 'TWO-SIDED' ELSE 'UNSPECIFIED' END AS sides FROM part""")
def scalar_functions(spark, sf):
    """Scalar functions that no other query calls by itself."""
    k2, k3, e = F.col("p_partkey") % 2, F.col("p_partkey") % 3, F.expr
    size = F.col("p_size").cast("string")
    number = F.concat(size, F.when(k2 == 1, ".5").otherwise(""))
    grade = F.when(k3 == 0, e("concat('ECOG of 0 or ', p_size % 5 + 1, ' on form AB-3')")).when(k3 == 1, e("concat('grade ', p_size % 6, ' in v1.0 at 55%')")).otherwise("none at 1.5")
    names = F.when(k3 == 0, F.array("p_type")).when(k3 == 1, F.array("p_type", "p_brand")).otherwise(F.array(F.col("p_type"), F.col("p_brand"), F.lit("x")))
    part = S.excerpt(F.col("p_name"), F.substr("p_name", F.lit(3), F.lit(2)))
    return t(spark, sf, "part").select(
        "p_partkey", S.number_text(number.cast("double")).alias("number"), S.scale_version("CTCAE", F.concat(F.lit(" "), size, F.lit(".0 "))).alias("version"), S.timepoint_label(F.concat(F.lit("c"), size, F.lit("d8"))).alias("label"), S.term(F.concat("p_brand", F.lit(" ;"))).alias("term"), S.grade_range(grade).alias("grades"),
        S.tokens_contained(F.array(F.lit("dat"), F.lit("handling")), F.array(F.lit("date"), F.when(k2 == 0, "handl").otherwise("rest"))).alias("contained"), S.citation_label(F.col("p_type"), F.lit("v1"), F.col("p_brand"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")), F.lit(9)).alias("citation"),
        F.concat_ws("|", F.left("p_name", F.lit(2)), part["match"], F.substr("p_name", F.lit(5))).alias("excerpt"), S.shade(F.col("p_size") % 9).alias("shade"), S.shorten(F.col("p_name"), 6).alias("short"), S.listed(names).alias("listed"), S.decimals_of(number).cast("long").alias("decimals"),
        S.sidedness(F.when(k3 == 0, "one-sided.").when(k3 == 1, "Two").otherwise("both")).alias("sides"))


SNIPPET = "substr(text, lo + 1, hi - lo)"


@query(f"""WITH a AS (SELECT doc_id, text, strpos(text, 'tion') - 1 AS place FROM documents WHERE strpos(text, 'tion') > 0), b AS (SELECT *, greatest(place - 120, 0) AS lo, least(place + 124, length(text)) AS hi FROM a),
c AS (SELECT *, CASE WHEN lo > 0 THEN '… ' || regexp_replace({SNIPPET}, '^[^ \\t\\n\\r\\f\\x0B]*[ \\t\\n\\r\\f\\x0B]+', '') ELSE {SNIPPET} END AS s FROM b),
e AS (SELECT *, CASE WHEN hi < length(text) THEN regexp_replace(s, '[ \\t\\n\\r\\f\\x0B]+[^ \\t\\n\\r\\f\\x0B]*$', '') || ' …' ELSE s END AS z FROM c)
SELECT doc_id, trim(regexp_replace(z, '{WS}', ' ', 'g')) AS snippet FROM e""")
def cited_snippets(spark, sf):
    """The text around a match, cut at word ends."""
    at = F.instr(F.col("text"), F.lit("tion")) - 1
    return t(spark, sf, "documents").where(at >= 0).select("doc_id", S.snippet(F.col("text"), at, F.lit(4)).alias("snippet"))


@query("""WITH f AS (SELECT ['CRITICAL', 'MAJOR', 'MINOR'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS s, o_orderkey % 3 AS r, o_orderpriority AS category, o_orderkey % 4 = 0 AS decided, [['SAP'], ['SAP', 'CSR'], ['CRF', 'CRF']][CAST(o_custkey % 3 AS INTEGER) + 1] AS types FROM orders), x AS (SELECT *, unnest(list_distinct(types)) AS type FROM f)
SELECT category, type AS "documentType", count(*) AS n, ['CRITICAL', 'MAJOR', 'MINOR'][CAST(min(r) AS INTEGER) + 1] AS worst, count(*) FILTER (NOT decided) AS open, least(16e-2, 5e-2 + 25e-3 * count(*)) AS shade FROM x GROUP BY ALL""")
def matrix_cells(spark, sf):
    """Cells of the matrix of categories and document types."""
    severity = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), (F.col("o_orderkey") % 3).cast("int"))
    k = F.col("o_custkey") % 3
    types = F.when(k == 0, F.array(F.lit("SAP"))).when(k == 1, F.array(F.lit("SAP"), F.lit("CSR"))).otherwise(F.array(F.lit("CRF"), F.lit("CRF")))
    decided = F.when(F.col("o_orderkey") % 4 == 0, F.struct(F.lit("CONFIRMED").alias("status")))
    return matrix.cells(t(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), severity.alias("severity"), types.alias("documentTypes"), decided.alias("disposition")))


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS open, (SELECT count(*) FROM events WHERE value / 1e2 < 5e-1) AS unsure FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def review_counts(spark, sf):
    """How many findings are open, and how many are below the review threshold."""
    findings = t(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    left = review.open_findings(findings, t(spark, sf, "labels").select(F.col("doc_id").alias("findingId")).distinct())
    unsure = t(spark, sf, "events").agg(F.count_if(review.below_threshold(F.col("value") / 100)).alias("unsure"))
    return left.agg(F.count("*").alias("open")).crossJoin(unsure)  # single rows


@query("""WITH e AS (SELECT 99000 + row_number() OVER (ORDER BY event_id) AS n, user_id, event_type, value FROM events), r AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT 'F-' || user_id AS "findingId", CASE WHEN arg_max(value, n) > 50 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS status, 'u' || CAST(floor(arg_max(value, n)) AS BIGINT) AS reviewer, 'seen, | and told ' || max(n) AS comment FROM r GROUP BY user_id""")
def latest_decisions(spark, sf):
    """The last decision on each finding, by the number of its event (beyond five digits too)."""
    rows = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    numbered = relational.dense_numbers(rows, ["event_id"], "n").withColumn("n", F.col("n") + 99000)
    status = F.when(F.col("value") > 50, "CONFIRMED").otherwise("DISMISSED")
    events = numbered.select(F.concat(F.lit("AE-"), F.col("n").cast("string")).alias("id"), F.lit("").alias("timestamp"), F.concat(F.lit("u"), F.floor("value").cast("string")).alias("actor"), F.when(F.col("event_type") == "purchase", "FINDING_REVIEWED").otherwise("RECORD_EXPORTED").alias("eventType"), F.concat(F.lit("F-"), F.col("user_id").cast("string"), F.lit("|"), status, F.lit("|seen, | and told "), F.col("n").cast("string")).alias("detail"))
    return review.decisions(events).select("findingId", "status", "reviewer", "comment")


@query("""SELECT 'AE-' || n AS id, row_number() OVER (ORDER BY n DESC) AS place FROM (SELECT 99000 + row_number() OVER (ORDER BY event_id) AS n, event_type FROM events) WHERE event_type = 'error'""")
def newest_events(spark, sf):
    """The log's events of one type, newest first, with their places in that list."""
    numbered = relational.dense_numbers(t(spark, sf, "events").select("event_id", "event_type"), ["event_id"], "n")
    events = numbered.select(F.concat(F.lit("AE-"), (F.col("n") + 99000).cast("string")).alias("id"), F.col("event_type").alias("eventType"))
    return relational.dense_numbers(review.newest(events, "error"), [-F.substring("id", 4, 20).cast("long")], "place").select("id", "place")
