"""Review state as an append-only log: dispositions, sign-off, exports. There is no update and no delete."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.model import AUDIT_EVENTS
from veritab.operators import relational
from veritab.operators.score import REVIEW_THRESHOLD

#: Event types and what a reviewer may decide.
EVENTS = ("DOCUMENT_INGESTED", "EXTRACTION_COMPLETED", "ANALYSIS_COMPLETED", "FINDING_REVIEWED", "REVIEW_SIGNED_OFF", "RECORD_EXPORTED")
STATUSES = ("CONFIRMED", "DISMISSED", "ACCEPTED_RISK", "NEEDS_CLARIFICATION")
COMMENT = 10


def numbered(events: DataFrame, order: list[str]) -> DataFrame:
    """events with ids AE-00001.. in order."""
    return relational.dense_ids(events, order, "AE-", 5)


def number_of(event_id: Column) -> Column:
    """The number in an event's id: ids are text, and AE-100000 comes after AE-99999."""
    return F.substring(event_id, 4, 20).cast("long")


@dataclass
class AuditLog:
    """Events below path, in segments: what one call appends is one file, or one folder of files.

    A writer first reserves a range of numbers: reservations are numbered files, each created only if
    there is none of its number, that say which events they are for. So two writers never take one
    event's number, and a writer goes on from the last reservation that it has seen; only its first
    call lists any. Segments show once they are whole. A writer that is lost between its reservation
    and its segment leaves a gap in the numbers, and one that is lost within its reservation an error
    for the next, which names the file.
    """

    spark: SparkSession
    path: str
    ruleset: str = "1.0"
    actor: str = "system"
    #: Seconds to wait for the text of another writer's reservation.
    patience: float = 30.0

    def __post_init__(self):
        self._seen: tuple[int, int] | None = None  # the last reservation seen, and the last number that it took

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(AUDIT_EVENTS).option("recursiveFileLookup", True).json(self.path)
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], AUDIT_EVENTS)

    def append(self, event_type: str, detail: str, timestamp: str, actor: str | None = None) -> str:
        return self.append_all([(event_type, detail, timestamp, actor)])[0]

    def append_all(self, events: Iterable[tuple[str, str, str, str | None]]) -> list[str]:
        """Appends (type, detail, timestamp, actor) events as one segment; their ids."""
        events = list(events)
        for kind in {e[0] for e in events} - set(EVENTS):
            raise ValueError(f"unknown event type {kind}")
        if not events:
            return []
        first = self._reserve(len(events))
        rows = [{"id": f"AE-{first + k:05d}", "timestamp": at, "actor": actor or self.actor, "eventType": kind, "detail": detail, "rulesetVersion": self.ruleset} for k, (kind, detail, at, actor) in enumerate(events)]
        path, fs = self._files()
        whole = self._path(path, f"{first:012d}.json")
        writing = self._path(path, f"_writing-{first:012d}")
        self._write(fs.create(writing, False), "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
        if not fs.rename(writing, whole):
            raise OSError(f"{whole} could not be made of {writing}")
        return [r["id"] for r in rows]

    def append_table(self, events: DataFrame, order: list[str]) -> int:
        """Appends the rows of events (eventType, detail, timestamp; and what order needs), in a total order, as one segment written by tasks; how many."""
        rows = relational.cut(events)
        if unknown := rows.where(~F.col("eventType").isin(*EVENTS) | F.col("eventType").isNull()).take(1):
            raise ValueError(f"unknown event type {unknown[0]['eventType']}")
        n = rows.count()
        if n:
            first = self._reserve(n)
            number = (F.col("_number") + (first - 1)).cast("string")
            ids = F.concat(F.lit("AE-"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number))
            out = relational.dense_numbers(rows, order, "_number").select(ids.alias("id"), "timestamp", F.lit(self.actor).alias("actor"), "eventType", "detail", F.lit(self.ruleset).alias("rulesetVersion"))
            out.write.json(f"{self.path.rstrip('/')}/{first:012d}")
        return n

    def snapshot(self, path: str) -> DataFrame:
        """All events so far, in order, as one table elsewhere: segments merged for readers. The log stays as it is."""
        self.events().withColumn("number", number_of(F.col("id"))).repartitionByRange("number").sortWithinPartitions("number").drop("number").write.parquet(path)
        return self.spark.read.schema(AUDIT_EVENTS).parquet(path)

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts):
        for name in parts[1:]:
            out = self.spark._jvm.org.apache.hadoop.fs.Path(parts[0], name)
            parts = (out, *parts[2:])
        return parts[0]

    def _write(self, out, text: str) -> None:
        data = bytearray(text.encode())
        for k in range(0, len(data), 1 << 20):
            out.write(data[k : k + (1 << 20)])
        out.close()

    def _reserve(self, n: int) -> int:
        """The first of n numbers that are this writer's alone."""
        path, fs = self._files()
        taken, last = self._seen or self._listed(path, fs)
        while True:
            own = self._path(path, "_numbers", f"{taken + 1:012d}")
            if self._created(own, fs, f"{last + 1} {last + n}\n"):
                self._seen = (taken + 1, last + n)
                return last + 1
            taken, last = taken + 1, self._last_of(own, fs)

    def _created(self, own, fs, text: str) -> bool:
        """Whether the file was made here; another writer may have made it first."""
        if fs.getScheme() == "file":  # there Hadoop looks and then creates, in two steps
            name = own.toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            try:
                with open(name, "x") as out:
                    out.write(text)
            except FileExistsError:
                return False
            return True
        try:
            out = fs.create(own, False)
        except Exception:
            if not fs.exists(own):
                raise
            return False
        self._write(out, text)
        return True

    def _listed(self, path, fs) -> tuple[int, int]:
        folder = self._path(path, "_numbers")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        taken = max((int(x) for x in names if x.isdigit()), default=0)
        return taken, (self._last_of(self._path(folder, f"{taken:012d}"), fs) if taken else 0)

    def _last_of(self, own, fs) -> int:
        """The last number of another writer's reservation; it may just be being written."""
        until = time.monotonic() + self.patience
        while True:
            stream = fs.open(own)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("\n"):
                return int(text.split()[1])
            if time.monotonic() > until:
                raise OSError(f"the reservation {own} was never finished")
            time.sleep(0.05)

    def dispose(self, finding: str, status: str, reviewer: str, comment: str, timestamp: str) -> str:
        """A reviewer's decision on a finding; the last one of a finding counts, all stay in the log."""
        if not reviewer.strip():
            raise ValueError("a reviewer is needed")
        if status not in STATUSES:
            raise ValueError(f"unknown status {status}")
        if len(comment.strip()) < COMMENT:
            raise ValueError(f"a comment of {COMMENT} characters is needed")
        return self.append("FINDING_REVIEWED", f"{finding}|{status}|{comment.strip()}", timestamp, reviewer.strip())

    def dispositions(self) -> DataFrame:
        """The last decision on each finding."""
        return decisions(self.events())

    def sign_off(self, findings: DataFrame, reviewer: str, timestamp: str, attested: bool = True) -> str:
        if not (attested and reviewer.strip()):
            raise ValueError("a name and an attestation are needed")
        if not findings.take(1):
            raise ValueError("there is nothing to sign off")
        if left := open_count(findings, self.dispositions()):
            raise ValueError(f"{left} findings are open")
        return self.append("REVIEW_SIGNED_OFF", f"signed off by {reviewer.strip()}", timestamp, reviewer.strip())

    def export(self, kind: str, timestamp: str) -> str:
        return self.append("RECORD_EXPORTED", kind, timestamp)


def decisions(events: DataFrame) -> DataFrame:
    """(findingId, status, reviewer, comment, timestamp): the last decision on each finding."""
    parts = F.split("detail", r"\|", 3)
    rows = events.where("eventType = 'FINDING_REVIEWED'").select(F.get(parts, F.lit(0)).alias("findingId"), F.get(parts, F.lit(1)).alias("status"), F.col("actor").alias("reviewer"), F.get(parts, F.lit(2)).alias("comment"), "timestamp", "id")
    return rows.groupBy("findingId").agg(*[F.max_by(c, number_of(F.col("id"))).alias(c) for c in ("status", "reviewer", "comment", "timestamp")])


def reviewed(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    """findings with their dispositions; null where a finding is open."""
    d = dispositions.select(F.col("findingId").alias("id"), F.struct("status", "reviewer", "comment", "timestamp").alias("disposition"))
    return findings.drop("disposition").join(d, "id", "left")


def below_threshold(confidence: Column) -> Column:
    """Whether a finding is so unsure that a report marks it; it is listed all the same."""
    return confidence < REVIEW_THRESHOLD


def open_findings(findings: DataFrame, dispositions: DataFrame) -> DataFrame:
    return findings.join(dispositions, findings.id == dispositions.findingId, "left_anti")


def open_count(findings: DataFrame, dispositions: DataFrame) -> int:
    return open_findings(findings, dispositions).count()


def filtered(findings: DataFrame, severity: str | None = None, category: str | None = None, document: str | None = None, status: str | None = None) -> DataFrame:
    """Findings that meet all conditions given; status OPEN means no disposition."""
    out = findings
    if severity:
        out = out.where(F.col("severity") == severity)
    if category:
        out = out.where(F.col("category") == category)
    if document:
        out = out.where(F.array_contains("documentTypes", document))
    if status:
        out = out.where(F.col("disposition").isNull() if status == "OPEN" else F.col("disposition.status") == status)
    return out


def newest(events: DataFrame, event_type: str | None = None) -> DataFrame:
    return (events.where(F.col("eventType") == event_type) if event_type else events).orderBy(F.desc(number_of(F.col("id"))))
