"""Callers' columns called like an operator's internal names, or like its outputs in another case."""

import pytest
from pyspark.sql import functions as F

from veritab.llm import bpe, decontaminate, licenses, lm, quality, toxicity, urls, warc

INTERNAL = ["row", "h", "d", "g", "n", "fp", "root", "learn", "tokens", "spans", "block", "bucket", "_r", "_bad", "_d", "_first", "_n", "_h", "_veritab_h", "_veritab_d", "veritab_lm"]


def with_extras(df, *outputs):
    """df with a column for each internal name, and for each output in another case."""
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in INTERNAL], *[F.lit("theirs").alias(o.upper() if "_" in o else o.capitalize()) for o in outputs])


def kept(out, outputs, n):
    assert all(list(map(str.lower, out.columns)).count(o) == 1 for o in outputs)
    rows = out.collect()
    assert len(rows) == n
    for r in rows:
        assert all(r[c] == f"mine {c}" for c in INTERNAL)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(["one two three four five six seven eight nine ten eleven", None, "", "released under the MIT License", "stupid text " * 9])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_quality_and_toxicity(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(5)], "doc_id long, quality int, toxic int")
    outputs = ("held_out", "score", "predicted")
    for judge in (quality.quality, toxicity.toxicity):
        plain = {r.doc_id: r.score for r in judge(docs, labels).collect()}
        assert {r.doc_id: r.score for r in kept(judge(with_extras(docs, *outputs), labels), outputs, 5)} == plain


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    outputs = ("n_words", "n_hit", "items", "contaminated")
    rows = kept(decontaminate.decontaminate(with_extras(docs, *outputs), items), outputs, 5)
    assert {r.doc_id: r.n_hit for r in rows} == {0: 10, 1: 0, 2: 0, 3: 0, 4: 0}


def test_bpe_licenses_and_language_model(spark, docs):
    assert len(kept(bpe.tokenized(with_extras(docs, "n_tokens", "ids"), outputs=("n_tokens", "ids")), ("n_tokens", "ids"), 5)) == 5
    assert any(r.reports for r in kept(licenses.license_scan(with_extras(docs, "reports")), ("reports",), 5))
    plain = {r.doc_id: (r.n_tokens, r.base_score) for r in lm.scored(docs).collect()}
    outputs = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert {r.doc_id: (r.n_tokens, r.base_score) for r in kept(lm.scored(with_extras(docs, *outputs)), outputs, 5)} == plain


def test_urls_and_archives(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", '<a href="http://example.com/en/">'), (2, "http://example.com/en/", "y" * 1200), (3, None, "y" * 1200)], "page_id long, url string, html string")
    outputs = ("host", "path", "rule", "verdict")
    assert {r.page_id: r.verdict for r in kept(urls.url_filter(with_extras(pages, *outputs)), outputs, 3)} == {r.page_id: r.verdict for r in urls.url_filter(pages).collect()}
    outputs = ("payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    rows = kept(warc.record_types(with_extras(pages, *outputs)), outputs, 3)
    assert {r.page_id: (r.record_type, r.refers_to) for r in rows} == {1: ("response", None), 2: ("revisit", 3), 3: ("response", None)}
