"""Pages filled by Spark against the plain loop."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from veritab.model import DESCRIPTORS, ITEMS
from veritab.sources import filling
from veritab.sources.fixtures import Block, _wrapped, item_rows

HEADED = f"{DESCRIPTORS}, docSeq int, header string, leaves int"


def authored(rng, n):
    words = lambda k: " ".join("w" * rng.randint(1, 14) for _ in range(k))
    out = []
    for _ in range(n):
        kind = rng.choice(["heading", "para", "para", "bullets", "table", "code", "redaction", "para"])
        rows = tuple(words(rng.randint(1, 4)) for _ in range(rng.choice([0, 1, 3, 20, 70]))) if kind in ("bullets", "table", "code") else ()
        out.append(Block(kind, words(rng.choice([0, 3, 60])) if kind != "heading" else words(2), rows))
    return out


@pytest.mark.parametrize("per_page,range_lines", [(50, 512), (50, 50), (7, 8), (1, 3)])
def test_like_the_loop(spark, per_page, range_lines):
    """Every item of documents of none to thousands of lines, whatever the ranges."""
    rng = random.Random(per_page)
    docs = {f"D{i}": (authored(rng, n), rng.randint(0, 2)) for i, n in enumerate([0, 1, 2, 5, 30, 150])}
    documents = spark.createDataFrame([(d, "SAP", f"{d}.pdf", f"title {d}", "v1", "", "", i, "" if i % 2 else f"head {d}", leaves) for i, (d, (_, leaves)) in enumerate(docs.items())], HEADED)
    blocks = spark.createDataFrame([(d, k, b.kind, b.text or None, list(b.rows) or None) for d, (own, _) in docs.items() for k, b in enumerate(own)] + [("unknown", 0, "para", "x", None)], filling.BLOCKS).repartition(5)
    made = filling.corpus(documents, blocks, per_page, range_lines)
    expected = sorted(r for i, (d, (own, leaves)) in enumerate(docs.items()) for r in item_rows(d, own, f"title {d}" if i % 2 else f"head {d}", leaves, per_page=per_page))
    got = sorted(tuple(r) for r in made["items"].select(*spark.createDataFrame([], ITEMS).columns).collect())
    assert len(got) == len(expected) and got == expected
    pages = {r.documentId: (r.pdfPages, r.printedPages, r.pageOffset) for r in made["page_map"].collect()}
    most = {d: max(r[1] for r in expected if r[0] == d) for d in docs}
    assert pages == {d: (most[d], most[d] - leaves, leaves) for d, (_, leaves) in docs.items()}


def test_wrapped(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "x" * 200, *(" ".join("w" * rng.randint(1, 40) for _ in range(80)) for _ in range(20))]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", filling.wrapped(F.col("s")).alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: _wrapped(s, 92) for i, s in enumerate(texts)}
    assert spark.range(1).select(filling.wrapped(F.lit(None).cast("string")).alias("l")).first().l == []


def test_many_documents_and_a_long_one(spark):
    """20,000 documents and one of 60,000 lines from ranges of numbers: the page map of equal heights by division."""
    ids = spark.range(20_000).select(F.concat(F.lit("D"), F.col("id")).alias("documentId"), F.col("id"))
    each = ids.select("documentId", F.lit(0).alias("blockSeq"), F.lit("code").alias("kind"), F.lit(None).cast("string").alias("text"), F.transform(F.sequence(F.lit(0), F.col("id") % 130), lambda i: i.cast("string")).alias("rows"))
    long = spark.range(60_000).select(F.lit("long").alias("documentId"), F.col("id").cast("int").alias("blockSeq"), F.lit("para").alias("kind"), F.lit("one").alias("text"), F.lit(None).cast("array<string>").alias("rows"))
    heads = ids.select("documentId").union(spark.createDataFrame([("long",)], "documentId string"))
    documents = heads.select(F.col("documentId").alias("id"), F.lit("SAP").alias("type"), *[F.lit("").alias(c) for c in ("fileName", "title", "version", "effectiveDate", "author")], F.lit(0).alias("docSeq"), F.lit("h").alias("header"), F.lit(0).alias("leaves"))
    pages = {r.documentId: r.printedPages for r in filling.corpus(documents, each.union(long))["page_map"].collect()}
    assert all(pages[f"D{i}"] == -(-(i % 130 + 1) // 50) for i in range(20_000))
    # 12.6 for the line and 12.6 of room: (684 - 12.6) // 25.2 + 1 = 27 lines a page, and 2,222 full pages and one more
    assert pages["long"] == -(-60_000 // 27)


def test_pages_of_the_documents(spark):
    """The registered query against the loop, over all documents of the smallest tables."""
    from tests.conftest import SF
    from veritab.plans.document_queries import filled_pages

    got = {r.documentId: (r.pdfPages, r.printedPages, r.pageOffset) for r in filled_pages(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        most = max(x[1] for x in item_rows("d", [Block("heading", r.source or ""), Block("para", r.text or "")], "h", 1))
        assert got[str(r.doc_id)] == (most, most - 1, 1)


def test_lines_by_one_match(spark):
    """Lines as the plain loop wraps them, whatever stands between words, and without a fold over a text's words."""
    rng = random.Random(5)
    texts = ["", " ", "\n\t", "w" * 300, "é" * 92, "é" * 93 + " a", "a b\u0085c  d", "𝒳" * 91 + " a", None]
    texts += [rng.choice(["", " "]) + "".join("w" * rng.choice([1, 3, 9, 91, 92, 93, 200][: rng.randint(1, 7)]) + rng.choice([" ", "  ", "\n", " \t", "\r\n"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", filling.wrapped(F.col("t")).alias("l")).collect()
    loop = lambda t: functools.reduce(lambda a, w: a[:-1] + [a[-1] + " " + w] if a and len(a[-1]) + 1 + len(w) <= 92 else [*a, w], [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w], [])
    assert {r.i: r.l for r in got} == {i: loop(t) for i, t in enumerate(texts)}
    assert "aggregate" not in str(filling.wrapped(F.col("t")))
