"""The log in segments: many events at once, several writers, no listing for each event."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from veritab.operators import review


def logs(spark, tmp_path, *actors):
    return [review.AuditLog(spark, str(tmp_path / "log"), actor=a) for a in actors]


def test_100_000_events_in_one_call(spark, tmp_path):
    (log,) = logs(spark, tmp_path, "a")
    assert log.append("RECORD_EXPORTED", "first", "t") == "AE-00001"
    ids = log.append_all(("RECORD_EXPORTED", f"n{k}", "t", None) for k in range(100_000))
    assert (ids[0], ids[-1]) == ("AE-00002", "AE-100001")
    segments = [x for x in os.listdir(tmp_path / "log") if x[0] not in "._"]
    assert sorted(segments) == ["000000000001.json", "000000000002.json"]
    rows = log.events()
    assert rows.count() == rows.select("id").distinct().count() == 100_001
    assert review.newest(rows).first().id == "AE-100001"


def test_a_table_of_events(spark, tmp_path):
    (log,) = logs(spark, tmp_path, "a")
    log.export("csv", "t")
    events = spark.range(5000).select(F.lit("DOCUMENT_INGESTED").alias("eventType"), F.concat(F.lit("d"), F.col("id")).alias("detail"), F.lit("t").alias("timestamp"), "id").repartition(4)
    assert log.append_table(events, ["id"]) == 5000
    assert log.export("csv", "t") == "AE-05002"
    got = {(r.id, r.detail) for r in log.events().where("eventType = 'DOCUMENT_INGESTED'").collect()}
    assert got == {(f"AE-{k + 2:05d}", f"d{k}") for k in range(5000)}
    assert log.append_table(events.limit(0), ["id"]) == 0
    with pytest.raises(ValueError):
        log.append_table(events.withColumn("eventType", F.lit("UPDATED")), ["id"])
    whole = log.snapshot(str(tmp_path / "snapshot"))
    assert whole.count() == log.events().count() == 5002


def test_two_writers_of_many_events(spark, tmp_path):
    one, other = logs(spark, tmp_path, "one", "other")
    write = lambda log: [x for k in range(12) for x in log.append_all([("RECORD_EXPORTED", f"{k}", "t", None)] * (k % 4 + 1))]
    with ThreadPoolExecutor(2) as pool:
        ids = [x for own in pool.map(write, (one, other)) for x in own]
    assert sorted(ids) == [f"AE-{k:05d}" for k in range(1, len(ids) + 1)] and len(ids) == 60
    assert sorted(r.id for r in one.events().collect()) == sorted(ids)


def test_no_listing_for_an_event(spark, tmp_path, monkeypatch):
    (log,) = logs(spark, tmp_path, "a")
    listed = []
    whole = review.AuditLog._listed
    monkeypatch.setattr(review.AuditLog, "_listed", lambda *a: listed.append(1) or whole(*a))
    for k in range(5):
        log.export(f"{k}", "t")
    assert len(listed) == 1
    (later,) = logs(spark, tmp_path, "b")
    assert later.export("x", "t") == "AE-00006" and log.export("y", "t") == "AE-00007" and len(listed) == 2


def test_a_writer_lost_within_its_reservation(spark, tmp_path):
    (log,) = logs(spark, tmp_path, "a")
    log.export("1", "t")
    open(tmp_path / "log" / "_numbers" / f"{2:012d}", "w").close()
    log.patience = 0.2
    with pytest.raises(OSError, match="never finished"):
        log.export("2", "t")
    with pytest.raises(ValueError):
        log.append("UPDATED", "", "t")
    assert log.append_all([]) == []
