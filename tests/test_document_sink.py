"""One file in order, written by tasks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veritab.sources import writers
from veritab.sources.document_sink import Frame, json_lists, write_document


def test_many_findings_in_order(spark, tmp_path):
    """300,000 rows by many tasks: a document that reads back equal, in order, and no file beside it."""
    n, path = 300_000, str(tmp_path / "report.json")
    findings = spark.range(n, numPartitions=13).select(F.format_string("F-%03d", n - F.col("id")).alias("id"), F.concat(F.lit('say "é"\n'), F.col("id")).alias("title"), F.lit(None).cast("string").alias("benignNote"))
    checks = spark.createDataFrame([("AC-010", "FAILED"), ("AC-002", "CONFIRMED")], "id string, outcome string")
    documents = spark.createDataFrame([], "documentId string")
    writers.report_json({"ruleset": "1.0"}, findings, checks, documents, path, {"reviewer": "R"})
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    assert list(read) == ["ruleset", "documents", "arithmetic", "findings", "signOff"] and read["documents"] == [] and read["signOff"] == {"reviewer": "R"}
    assert [c["id"] for c in read["arithmetic"]] == ["AC-002", "AC-010"]
    assert [int(x["id"][2:]) for x in read["findings"]] == list(range(1, n + 1))
    assert read["findings"][6] == {"id": "F-007", "title": f'say "é"\n{n - 7}', "benignNote": None}
    assert os.listdir(tmp_path) == ["report.json"]


def test_blocks_without_rows(spark, tmp_path):
    """Frames of empty blocks stand, first, between and last; null texts are left out; a file there is replaced."""
    path = str(tmp_path / "out.txt")
    none = spark.createDataFrame([], "a string, o int")
    some = spark.createDataFrame([("x", 2), (None, 1), ("y", 0), ("x", 2)], "a string, o int")
    for _ in range(2):
        write_document([(Frame("<0", ",", "0>"), none, "a", ["o"]), (Frame("<1", ",", "1>"), some, "a", [-F.col("o"), "a"]), (Frame("<2", ",", "2>"), none, "a", ["a"])], path)
        with open(path) as f:
            assert f.read() == "<00><1x,x,y1><22>"
    write_document([(Frame("(", ",", ")"), none, "a", ["o"])], path)
    with open(path) as f:
        assert f.read() == "()"
    json_lists({}, [("l", none, ["o"])], {}, path)
    with open(path) as f:
        assert json.load(f) == {"l": []}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    rows = spark.range(1000, numPartitions=5).select(F.when(F.col("id") == 700, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("a"), "id")
    with pytest.raises(Exception, match="broken"):
        write_document([(Frame(), rows, "a", ["id"])], path)
    assert os.listdir(tmp_path) == []


def test_audit_and_printed_files(spark, tmp_path):
    events = spark.createDataFrame([(f"AE-{k}", "t", 'an "actor"', "E", None, "1.0") for k in (100000, 99999, 2)], "id string, timestamp string, actor string, eventType string, detail string, rulesetVersion string")
    writers.audit_file(events, str(tmp_path / "a.csv"))
    with open(tmp_path / "a.csv") as f:
        lines = f.read().split("\n")
    assert lines[0] == '"id","timestamp","actor","eventType","detail","rulesetVersion"' and [x.split(",")[0] for x in lines[1:]] == ['"AE-2"', '"AE-99999"', '"AE-100000"', ""] and lines[1] == '"AE-2","t","an ""actor""","E","","1.0"'
