import json
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from veritab.model import AUDIT_EVENTS, DESCRIPTORS, ITEMS
from veritab.operators import ingest, matrix, relational, review
from veritab.sources import fixtures, readers, writers
from veritab.sources.fixtures import Block


@pytest.fixture(scope="module")
def tables(spark):
    blocks = [
        Block("heading", "1 Introduction"), Block("para", "A total of 620 subjects will be randomised. " * 4), Block("redaction"), Block("para", "A second paragraph stands here on its own."),
        Block("heading", "2 Programs"), Block("code", rows=("proc means data=adsl;", "run;")), Block("heading", "LIST OF ABBREVIATIONS"), Block("table", rows=("AE Adverse event", "CI Confidence interval", "note nothing here")),
        Block("heading", "2 Programs"), *[Block("para", f"Filler paragraph number {i} runs over the line so that pages fill up and the footer repeats on every one of them.") for i in range(40)]]
    rows = fixtures.item_rows("D", blocks, "Study X protocol header", leaves=2)
    rows += [("D", 2, 90, "Study header", 68.0, 797.6, 50.0, 7.5, 0, "Times")]  # a shortened header
    descriptors = readers.with_order(spark.createDataFrame([("D", "PROTOCOL", "d.pdf", "T", "v1.0", "2024", "A")], DESCRIPTORS))
    return ingest.ingest(spark.createDataFrame(rows, ITEMS).repartition(3), descriptors)


def test_structure(tables):
    sections = [(r.id, r.heading, r.printedPage) for r in tables["sections"].orderBy("sectionSeq").collect()]
    assert [s[0] for s in sections] == ["FRONT MATTER", "1", "2", "LIST OF ABBREVIATIONS", "2#4"] and sections[0][2] is None and sections[1][2] == 1
    paragraphs = tables["paragraphs"].orderBy("sectionSeq", "paraSeq").collect()
    one = [p for p in paragraphs if p.sectionId == "1"]
    assert [p.text[:20] for p in one] == ["A total of 620 subje", "[REDACTED]", "A second paragraph s"] and one[0].printedPage == 1 and one[0].pdfPage == 3
    code = [p for p in paragraphs if p.sectionId == "2"]
    assert code[0].kind == "CODE" and code[0].text == "proc means data=adsl;\nrun;"
    assert not [p for p in paragraphs if "Confidential" in p.text or "Study header" in p.text or "DRAFT" in p.text]


def test_documents(tables):
    d = tables["documents"].first()
    assert d.pageOffset == 2 and d.consistent and d.rotatedItemsDropped == 2 * d.pdfPageCount and "Study X protocol header" in d.boilerplate
    assert [(r.acronym, r.expansion) for r in tables["abbreviations"].orderBy("abbrSeq").collect()] == [("AE", "Adverse event"), ("CI", "Confidence interval")]


def test_page_map_of_a_generated_corpus(spark):
    """Documents with one and two front leaves: what ingest reads off their pages is what the generator wrote."""
    body = tuple(Block("para", f"Paragraph number {i} is long enough to fill a line of the page and some of the next one as well.") for i in range(60))
    made = fixtures.corpus(spark, [fixtures.Document("P", "PROTOCOL", "A protocol", (Block("heading", "1 One"), *body), leaves=2), fixtures.Document("S", "SAP", "A plan", (Block("heading", "1 One"), *body[:9]))])
    tables = ingest.ingest(made["items"], made["descriptors"])
    got = {(r.documentId, r.documentType, r.version, r.fileName, r.pdfPageCount, r.printedPageCount, r.pageOffset) for r in tables["documents"].collect()}
    assert got == {tuple(r) for r in made["page_map"].collect()} and len(got) == 2


def test_hyphens_and_masks(spark):
    r = spark.range(1).select(ingest.reflowed(F.array(F.lit("treat-"), F.lit("ment is"), F.lit("given"))).alias("a"), ingest.masked(F.lit("Page 12  of 30")).alias("b"), fixtures.sanitized(F.lit("“a” ≥ 5—漢")).alias("c"), readers.document_type(F.lit("x_SAP_v1.pdf")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("treatment is given", "page # of #", '"a" >= 5-?', "SAP")


def test_anchors_do_not_chain(spark):
    r = spark.range(1).select(relational.anchored(F.array(*[F.lit(x) for x in (0.0, 2.0, 4.0, 6.0, 6.1)]), 2.2).alias("n")).first()
    assert r.n == [1, 1, 2, 2, 2]


def test_components_whatever_the_partitions(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)]
    for n in (1, 5):
        got = {r.node: r.root for r in relational.components(spark.createDataFrame(edges, "a long, b long").repartition(n)).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_review(spark, tmp_path):
    log = review.AuditLog(spark, str(tmp_path / "audit"))
    findings = spark.createDataFrame([("F-001", "MAJOR", "NUMERIC", "INTRA_DOCUMENT", ["SAP", "CSR"]), ("F-002", "MINOR", "EDITORIAL", "CROSS_DOCUMENT", ["CSR"])], "id string, severity string, category string, scope string, documentTypes array<string>")
    with pytest.raises(ValueError):
        log.dispose("F-001", "CONFIRMED", "R", " short ", "t")
    with pytest.raises(ValueError):
        log.sign_off(findings, "R", "t")
    log.dispose("F-001", "CONFIRMED", "R", 'first, "quoted" comment', "2024-01-01T00:00:00Z")
    log.dispose("F-001", "DISMISSED", "R", "second comment here", "2024-01-01T01:00:00Z")
    log.dispose("F-002", "CONFIRMED", "R", "third comment here", "2024-01-01T05:00:00Z")
    assert {r.findingId: r.status for r in log.dispositions().collect()} == {"F-001": "DISMISSED", "F-002": "CONFIRMED"}
    assert log.sign_off(findings, "R", "t") == "AE-00004"
    seen = review.reviewed(findings, log.dispositions())
    assert review.filtered(seen, document="SAP", status="DISMISSED").count() == 1 and review.filtered(seen, status="OPEN").count() == 0
    assert [r.id for r in review.newest(log.events(), "FINDING_REVIEWED").collect()] == ["AE-00003", "AE-00002", "AE-00001"]
    lines = [r.line for r in writers.csv_lines(log.events()).orderBy("id").collect()]
    assert '""quoted""' in lines[0]
    writers.audit_csv(log.events(), str(tmp_path / "csv"))
    m = {(r.category, r.documentType): (r.n, r.worst, r.open) for r in matrix.cells(seen).collect()}
    assert m["NUMERIC", "SAP"] == (1, "MAJOR", 0)


def test_log_beyond_five_digits(spark, tmp_path):
    log = review.AuditLog(spark, str(tmp_path / "audit"))
    log._reserve(99_997)
    assert log.export("csv", "t") == "AE-99998"
    assert log.dispose("F-001", "CONFIRMED", "R", "the first comment", "t1") == "AE-99999"
    assert log.dispose("F-001", "DISMISSED", "R", "the second comment", "t2") == "AE-100000"
    assert [r.status for r in log.dispositions().collect()] == ["DISMISSED"]
    assert [r.id for r in review.newest(log.events()).collect()] == ["AE-100000", "AE-99999", "AE-99998"]


def test_two_writers_never_share_a_number(spark, tmp_path):
    one, other = (review.AuditLog(spark, str(tmp_path / "audit"), actor=a) for a in ("one", "other"))
    with ThreadPoolExecutor(2) as pool:
        ids = [x for own in pool.map(lambda log: [log.export(f"csv {i}", "t") for i in range(10)], (one, other)) for x in own]
    assert sorted(ids) == [f"AE-{i:05d}" for i in range(1, 21)]
    rows = one.events().collect()
    assert sorted(r.id for r in rows) == sorted(ids) and {r.actor for r in rows} == {"one", "other"}


def test_anchors_of_rows_like_a_fold(spark):
    import random

    r = random.Random(2)
    rows = [(g, round(r.random() * 40, 1)) for g in "ab" for _ in range(150)] + [("c", 1.0), ("d", None)]
    got = {(x.g, x.v): x.bucket for x in relational.anchored_rows(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", 2.2).collect()}
    expected = {}
    for g in "abc":
        anchor, n = None, 0
        for v in sorted({v for k, v in rows if k == g}):
            if anchor is None or v > anchor + 2.2:
                anchor, n = v, n + 1
            expected[g, v] = n
    assert got == expected


def test_numbers_over_ranges(spark):
    rows = [(i % 7, f"k{i % 11}", i) for i in range(500)]
    got = relational.dense_ids(spark.createDataFrame(rows, "a int, b string, i int").repartition(6), [-F.col("a"), F.collate("b", "UNICODE"), "i"], "X-", 2).collect()
    expected = {r[2]: f"X-{k + 1:02d}" for k, r in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].replace("k", "").zfill(0), r[2])))}
    order = sorted(got, key=lambda r: int(r.id[2:]))
    assert [int(r.id[2:]) for r in order] == list(range(1, 501)) and len(expected) == 500
    assert [(r.a, r.b, r.i) for r in order] == sorted(((r.a, r.b, r.i) for r in got), key=lambda r: (-r[0], r[1], r[2]))


def test_report(spark, tmp_path):
    findings = spark.createDataFrame([("F-002", "MINOR", "t2", "d2", 0.4, "why", "do", [("SAP", "v1", "1", 2, 4, "a snippet", "7")]), ("F-001", "CRITICAL", "t1", "d1", 0.9, "why", "do", [("CSR", "v2", "2", None, 1, "other", "8")])], "id string, severity string, title string, description string, confidence double, regulatoryContext string, suggestedAction string, o array<struct<documentType:string,version:string,sectionId:string,printedPage:int,pdfPage:int,snippet:string,value:string>>")
    findings = findings.select("*", F.transform("o", lambda o: F.struct(o["value"].alias("value"), F.struct(*[o[c].alias(c) for c in ("documentType", "version", "sectionId", "printedPage", "pdfPage", "snippet")]).alias("citation"))).alias("occurrences")).drop("o")
    checks = spark.createDataFrame([("AC-001", "CONFIRMED"), ("AC-002", "FAILED")], "id string, outcome string")
    documents = spark.createDataFrame([("D2", "CSR", "v2", "2024", "B", 3, 4, 1), ("D1", "SAP", "v1", "2023", "A", 5, 6, 0)], "documentId string, documentType string, version string, effectiveDate string, author string, printedPageCount int, pdfPageCount int, docSeq int")
    texts = [r.text for r in writers.printed_report(findings, checks, documents, {"Study": "X"}).collect()]
    assert texts[0] == "Study: X\nDocuments: 2\nFindings: 2, critical 1, major 0, minor 1"
    assert texts[1:3] == ["SAP | v1 | 2023 | A | 5 printed / 6 pages", "CSR | v2 | 2024 | B | 3 printed / 4 pages"]
    assert texts[3] == "1 of 2 recomputed derivations give what is stated." and texts[4].startswith("CRITICAL  F-001") and '"a snippet"' in texts[5] and "below the review threshold" in texts[5] and "below" not in texts[4]
    assert "Reviewer: ____" in texts[6]
    import json as j

    writers.report_json({"study": "X"}, findings, checks, documents, str(tmp_path / "r.json"), {"reviewer": "R", "timestamp": "t"})
    doc = j.loads((tmp_path / "r.json").read_text())
    assert doc["study"] == "X" and [x["id"] for x in doc["findings"]] == ["F-001", "F-002"] and len(doc["arithmetic"]) == 2 and doc["signOff"]["reviewer"] == "R"
    writers.report_text(findings, checks, documents, str(tmp_path / "r.txt"), {"Study": "X"})
    assert (tmp_path / "r.txt").read_text() == "\n\n".join(texts) + "\n"
    assert writers.printed_report(findings.limit(0), checks.limit(0), documents, sign_off={"reviewer": "R", "timestamp": "t"}).count() == 5


def test_files_and_decoder(spark, tmp_path):
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x_sap.pdf").write_bytes(b"one|two\fthree")
    wanted = spark.createDataFrame([("D", "SAP", "x_sap.pdf", "T", "v1", "", "")], DESCRIPTORS)
    files = readers.corpus_files(spark, str(tmp_path / "pdf"), wanted)
    assert files.count() == 1 and [(r.id, r.type) for r in readers.found_files(spark, str(tmp_path / "pdf")).collect()] == [("x_sap", "SAP")]
    for folder in ("b", "a"):  # a name in several folders is one document
        (tmp_path / "pdf" / folder).mkdir()
        (tmp_path / "pdf" / folder / "twice.pdf").write_bytes(folder.encode())
    named = lambda name: [bytes(r.content) for r in readers.corpus_files(spark, str(tmp_path / "pdf"), wanted.withColumn("fileName", F.lit(name))).collect()]
    assert named("twice.pdf") == [b"a"] and named("b/twice.pdf") == [b"b"]
    with pytest.raises(FileNotFoundError):
        named("ice.pdf")
    with pytest.raises(FileNotFoundError):
        readers.corpus_files(spark, str(tmp_path / "pdf"), wanted.withColumn("fileName", F.lit("none.pdf")))
    pages = lambda data: [[{"text": t, "x": 0.0, "y": 700.0 - k, "width": 9.0, "height": 9.0, "rotation": 0, "fontFamily": "Times"} for k, t in enumerate(p.split("|"))] for p in data.decode().split("\f")]
    assert [(r.pdfPage, r.itemSeq, r.text) for r in readers.decoded(files, pages).orderBy("pdfPage", "itemSeq").collect()] == [(1, 0, "one"), (1, 1, "two"), (2, 0, "three")]


def test_new_paragraphs_reopen_what_they_touch(spark, tmp_path):
    from tests.helpers import paragraphs, rows_of
    from veritab.model import ABBREVIATIONS, SECTIONS
    from veritab.operators.catalogue import BY_ID
    from veritab.plans.run import RuleExtractor
    from veritab.streaming import audit

    none = spark.createDataFrame([], SECTIONS), spark.createDataFrame([], ABBREVIATIONS)
    extractor, seen = RuleExtractor([BY_ID["schedule.visit_window"], BY_ID["numeric.dropout_rate"]]), []
    facts = lambda rows: extractor.extract(rows, *none).select("documentId", "conceptKey", "normalizedValue")
    sink = lambda rows, number: seen.append((number, sorted((r.documentId, r.normalizedValue) for r in rows.collect())))
    for doc, text in (("A", "Visits may shift ±3 days, with a dropout rate of 10 %"), ("B", "Visits may shift ±5 days")):
        paragraphs(spark, rows_of(text, doc=doc)).write.mode("append").parquet(str(tmp_path / "in"))
        q = audit.on_new_paragraphs(audit.paragraph_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "checkpoint"), facts, sink)
        q.awaitTermination()
    assert seen == [(0, [("A", "+/-3 days"), ("A", "10%")]), (1, [("A", "+/-3 days"), ("B", "+/-5 days")])]


def test_log_has_no_update():
    source = open(os.path.join(os.path.dirname(review.__file__), "review.py")).read()
    assert not re.search(r"overwrite|\bdelete\b\(|\.unlink|mode\(\"(?!append)", source)


def test_audit_stream(spark, tmp_path):
    from veritab.streaming import audit

    spark.createDataFrame([("AE-00001", "2024-01-01T00:10:00Z", "a", "FINDING_REVIEWED", "", "1.0"), ("AE-00002", "2024-01-01T00:20:00Z", "a", "FINDING_REVIEWED", "", "1.0")], AUDIT_EVENTS).write.json(str(tmp_path / "in"))
    q = audit.event_counts(audit.audit_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.eventType, r.n) for r in spark.table("counts").collect()] == [("FINDING_REVIEWED", 2)]
