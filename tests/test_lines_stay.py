"""Lines are cleaned where they are: repeated lines go to them, unless there are many."""

from pyspark.sql import functions as F

from veritab.operators import ingest


def _lines(spark):
    rows = []
    for doc in ("A", "B"):
        for page in range(1, 7):
            rows += [(doc, page, 1, "Report of the whole study", 68.0, 800.0, 9.5, False), (doc, page, 2, f"Page {page} of 9", 68.0, 52.0, 7.5, False)]
            rows += [(doc, page, 3 + k, f"{doc} says {'x' * (page * 7 + k)}", 68.0, 700.0 - 12 * k, 9.5, False) for k in range(3)]
        rows += [(doc, 7, 1, "Report of study", 68.0, 800.0, 9.5, False), (doc, 7, 2, "CCI", 68.0, 700.0, 9.5, False)]
    return spark.createDataFrame(rows, "documentId string, pdfPage int, lineSeq int, text string, x double, y double, fontSize double, mono boolean")


def _rows(df):
    return sorted(df.select("documentId", "pdfPage", "lineSeq", "text").collect())


def test_no_line_is_shuffled_to_be_cleaned(spark):
    lines = _lines(spark)
    kept = ingest.without_boilerplate(lines, ingest.boilerplate(lines, lines.select("documentId", "pdfPage").distinct()))
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert len(_rows(kept)) == 2 * (6 * 3 + 1)
    assert [r.text for r in kept.where("pdfPage = 7").collect()] == ["[REDACTED]"] * 2


def test_many_repeated_lines_give_the_same(spark, monkeypatch):
    lines = _lines(spark)
    repeated = ingest.boilerplate(lines, lines.select("documentId", "pdfPage").distinct())
    few = _rows(ingest.without_boilerplate(lines, repeated))
    monkeypatch.setattr(ingest, "FEW_REPEATED", 0)
    assert _rows(ingest.without_boilerplate(lines, repeated)) == few


def test_lines_are_ordered_once(spark):
    """What is left to do behind the stored pieces knows no single lines."""
    _, paragraphs = ingest.structure(_lines(spark))
    plan = paragraphs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "lineSeq" not in plan
    assert paragraphs.agg(F.sum(F.size("lines"))).first()[0] == 2 * (6 * 5 + 2)
