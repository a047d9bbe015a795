"""Segmented scans against windows by key, and the structure of documents against the same rules said with windows by document."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from veritab.operators import ingest, relational, scans
from veritab.operators.ingest import PAGE, headings, reflowed

LINE = "documentId string, pdfPage int, lineSeq int, text string, x double, y double, fontSize double, mono boolean"


def rows_of(seed, documents=4, pages=30):
    r = random.Random(seed)
    heads = ["1 Introduction", "2 Aims", "APPENDIX 1: Tables", "SUMMARY OF ALL", "2 Aims", "3.1. Methods"]
    out = []
    for d in range(documents):
        few = d == 0  # one document holds most pages; one has a section of all pages
        for p in range(1, (pages * 5 if few else pages) + 1):
            if r.random() < 0.1:
                continue  # a page without lines
            y = 780.0
            for k in range(1, r.randint(2, 9)):
                y -= r.choice([12.0, 12.0, 12.0, 30.0])
                head = d != 1 and r.random() < 0.08
                out.append((f"D{d}", p, k, r.choice(heads) if head else r.choice(["some words", "an end.", "a colon:", "and then"]), 50.0, y, 12.0 if head else 9.0, not head and r.random() < 0.1))
    return out


def plain(lines):
    """The same with windows over whole documents and sections."""
    doc, page = Window.partitionBy("documentId").orderBy("pdfPage", "lineSeq"), Window.partitionBy(*PAGE).orderBy("lineSeq")
    marked = headings(lines).withColumn("gap", F.lag("y").over(page) - F.col("y"))
    least = marked.groupBy(*PAGE).agg((ingest.PARAGRAPH * F.min(F.when(F.col("gap") > 1, F.col("gap")))).alias("limit"))
    rows = marked.join(least, PAGE).withColumn("section", F.sum(F.col("headingId").isNotNull().cast("int")).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("documentId", "section").orderBy("pdfPage", "lineSeq")
    lag = lambda c: F.lag(c).over(own)
    same = lag("pdfPage") == F.col("pdfPage")
    starts = lag("pdfPage").isNull() | (lag("mono") != F.col("mono")) | (same & F.coalesce(lag("y") - F.col("y") > F.col("limit"), F.lit(False))) | (~same & F.trim(lag("text")).rlike("[.:;]$"))
    body = relational.islands(rows.where("headingId IS NULL"), ["documentId", "section"], ["pdfPage", "lineSeq"], starts, "para")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pdfPage", "lineSeq", "text"))), lambda x: x["text"])
    out = body.groupBy("documentId", "section", "para").agg(listed.alias("lines"), F.min("pdfPage").alias("page"), F.bool_and("mono").alias("code"))
    return {(r.documentId, r.section, r.para, r.page, r.text) for r in out.withColumn("text", F.when(F.col("code"), F.array_join("lines", "\n")).otherwise(reflowed(F.col("lines")))).collect()}


@pytest.mark.parametrize("easy", [10**6, 0])
def test_structure(spark, monkeypatch, easy):
    monkeypatch.setattr(scans, "EASY_ROWS", easy)
    lines = spark.createDataFrame(rows_of(1), LINE).repartition(5)
    sections, paragraphs = ingest.structure(lines)
    got = [(r.documentId, r.sectionSeq, r.paraSeq, r.pdfPage, r.text) for r in paragraphs.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(lines)
    ids = {}
    for r in sorted(sections.collect(), key=lambda r: (r.documentId, r.sectionSeq)):
        base = r.id.split("#")[0]
        assert r.id == (f"{base}#{r.sectionSeq}" if (r.documentId, base) in ids else base)
        ids[r.documentId, base] = True
    assert any("#" in r.id for r in sections.collect())


@pytest.mark.parametrize("easy", [10**6, 0])
def test_running(spark, monkeypatch, easy):
    monkeypatch.setattr(scans, "EASY_ROWS", easy)
    r = random.Random(5)
    rows = [(k, i, r.randint(0, 5), r.choice([None, f"v{i}"])) for k in ("a", "b", "c", "d") for i in range({"a": 900, "b": 1, "c": 40, "d": 300}[k])]
    got = scans.running(spark.createDataFrame(rows, "k string, i int, n long, v string").repartition(6), ["k"], ["i"], sums=["n"], lasts=["v"])
    assert got.columns == ["k", "i", "n", "v", "before_n", "last_v"]
    expected, total, last = set(), {}, {}
    for k, i, n, v in rows:
        expected.add((k, i, n, v, total.get(k, 0), last.get(k)))
        total[k] = total.get(k, 0) + n
        last[k] = v or last.get(k)
    assert {tuple(x) for x in got.collect()} == expected


def test_empty(spark):
    assert scans.running(spark.createDataFrame([], "k string, i int, n long"), ["k"], ["i"], sums=["n"]).count() == 0
    sections, paragraphs = ingest.structure(spark.createDataFrame([], LINE))
    assert sections.count() == 0 and paragraphs.count() == 0


def test_numbers_within(spark):
    rows = [(k, i) for k in "ab" for i in range(50)]
    got = scans.numbered_within(spark.createDataFrame(rows, "k string, i int").repartition(4), "k", ["i"], "n").collect()
    assert {(r.k, r.i, r.n) for r in got} == {(k, i, i + 1) for k, i in rows}
