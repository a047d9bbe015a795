"""WARC archives of pages: written by Spark's text writer, read back by boundary-chain verification.

Reading. Archives are cut at every occurrence of the record magic, which Spark's text source does
in splits of any size. Each piece is a candidate record at some offset; a candidate with a sound
header names its successor, the offset after its declared payload. Only the candidates that the
chain of successors reaches from the file's start are records: splits follow their own chains,
and pointer jumping over splits doubles the stretch known to be reachable every round. A magic inside a payload starts a candidate
that no record leads to; its piece goes back to the payload it was cut from.

Writing. Of the rows with equal payloads of at least MIN_REVISIT bytes, the one with the largest
page_id is a response and the others are revisits of it. Payloads are never shuffled for that:
only digests are grouped, and those of repeated payloads are broadcast if they are few (counted
first), else joined.

Defined results. A null html is an empty payload; a null url an empty target. A null page_id is
written without an id and ranks below every id. Rows that share the largest page_id of a payload
are all responses. Header lines never hold line breaks (they are replaced by blanks). A very long
payload is one record; other columns of pages are not written. An empty table gives an empty archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, shared_dir, table, written

#: Fixed values of the format.
MAGIC, CRLF = "WARC/1.1\r\n", "\r\n"
MIN_REVISIT = 1000
#: Digests of repeated payloads are broadcast up to this many (about 100 bytes each).
BROADCAST_ROWS = 100_000
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value) -> list:
    return [F.lit(f"{name}: "), value, F.lit(CRLF)]


def record_types(pages: DataFrame) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, record_type and refers_to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.withColumns({"payload": payload, "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload.cast("binary"))})
    large = rows.where(F.col("payload_bytes") >= MIN_REVISIT).select("payload_digest", "page_id")
    repeated = checkpointed(large.groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("payload_digest").alias("_d"), "_first"))
    side = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    out = rows.join(side, (rows["payload_digest"] == side["_d"]) & (rows["payload_bytes"] >= MIN_REVISIT), "left")
    revisit = side["_first"].isNotNull() & ~rows["page_id"].eqNullSafe(side["_first"])
    made = {"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, side["_first"])}
    return out.select(*[rows[f"`{c}`"] for c in rows.columns if c.lower() not in made], *[v.alias(c) for c, v in made.items()])


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes a record for each row of pages (page_id, url, html) below path; one archive for each task."""
    rows = record_types(pages)
    flat = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    header = [
        *[F.lit(MAGIC)],
        *_line("WARC-Type", F.col("record_type")),
        *_line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), name, F.lit(">"))),
        *_line("WARC-Date", F.lit(DATE)),
        *_line("WARC-Target-URI", flat),
        *_line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        *_line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(""),
        *_line("Content-Type", F.lit("text/html")),
        *_line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF), body, F.lit(CRLF),
    ]
    rows.select(F.concat(*header).alias("value")).write.option("lineSep", CRLF).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)$", re.M)
_PIECES = "file string, split long, at long, size long, next long, kind string, target string, page string, refers string, digest string, declared long, head long, body binary"


def _pieces(batches):
    """A row for each piece of the archives, with its place among the bytes of its split.

    Pieces that hold their whole record carry its payload's digest; others keep their bytes.
    """
    magic, here, at = MAGIC.encode(), None, 0
    for b in batches:
        out = []
        for file, split, value in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("value").cast(pa.binary()).to_pylist(), strict=True):
            if (file, split) != here:
                here, at = (file, split), 0
            row = {"file": file, "split": split, "at": at, "size": len(value) + len(magic), "next": None, "kind": None, "target": None, "page": None, "refers": None, "digest": None, "declared": None, "head": None, "body": None}
            end = value.find(b"\r\n\r\n")
            fields = {k.lower(): v.rstrip(b"\r").decode("utf-8", "replace") for k, v in _FIELD.findall(value[: end + 2])} if end >= 0 else {}
            length = fields.get(b"content-length", "")
            if {b"warc-type", b"warc-record-id"} <= fields.keys() and length.isascii() and length.isdigit():
                body, size = end + 4, int(length)
                row |= {"kind": fields[b"warc-type"], "target": fields.get(b"warc-target-uri"), "page": fields[b"warc-record-id"], "refers": fields.get(b"warc-refers-to"), "head": body + len(magic), "next": at + len(magic) + body + size + 4, "declared": size}
                if row["kind"] == "revisit":
                    row |= {"digest": fields.get(b"warc-payload-digest", "").rpartition(":")[2], "declared": int(fields.get(b"x-payload-length", "0"))}
                elif body + size + 4 == len(value):
                    row["digest"] = hashlib.sha1(value[body : body + size]).hexdigest()
            if row["digest"] is None:
                row["body"] = value
            at += row["size"]
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)


_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[k]) for n, k in (x.split() for x in _PIECES.split(", "))])


def _leaving(_, rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, the first offset of its chain that is no candidate of the split."""
    rows = rows.sort_values("at")
    out: dict[int, int] = {}
    for at, onward in zip(rows["at"].tolist()[::-1], rows["next"].tolist()[::-1], strict=True):
        out[at] = out.get(onward, onward)
    return pd.DataFrame({"file": rows["file"], "split": rows["split"], "at": rows["at"], "leaves": [out[a] for a in rows["at"]]})


def _passed(_, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that the chain from its entry passes."""
    onward, out = dict(zip(rows["at"].tolist(), rows["next"].tolist(), strict=True)), []
    at = int(rows["entry"].iloc[0])
    while at in onward:
        out.append(at)
        at = onward[at]
    return pd.DataFrame({"file": [rows["file"].iloc[0]] * len(out), "at": out})


def reachable(nodes: DataFrame) -> DataFrame:
    """Of nodes (file, split, at, next), those (file, at) that the chains from each file's start reach.

    Each split first follows its own chains to where they leave it. Pointer jumping over splits
    then finds where the chain from the start enters each: after round i every candidate knows
    where its chain is 2**i splits on, and all entries less than 2**i splits from the start are
    known. A last look at each split walks from its entry.
    """
    leaving = checkpointed(nodes.groupBy("file", "split").applyInPandas(_leaving, "file string, split long, at long, leaves long"))
    places = leaving.select("file", "split", "at")
    entries = leaving.where("at = 0").select("file", "split", "at")
    jump = leaving.select("file", "at", "leaves")
    found = entries.count()
    while found:
        onward = entries.join(jump, ["file", "at"]).select("file", F.col("leaves").alias("at")).join(places, ["file", "at"])
        entries = checkpointed(entries.unionByName(onward.select("file", "split", "at")).distinct())
        if (now := entries.count()) == found:
            break
        found = now
        further = jump.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
        jump = checkpointed(jump.join(further, ["file", "leaves"]).select("file", "at", F.col("further").alias("leaves")))
    entered = nodes.join(entries.select("file", "split", F.col("at").alias("entry")), ["file", "split"])
    return checkpointed(entered.groupBy("file", "split").applyInPandas(_passed, "file string, at long"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below path: file, at (offset), record_type, target, page, refers, payload_bytes, payload_digest."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    pieces = written(lines.mapInArrow(_pieces, _PIECES), "warc-pieces")
    # The source cuts behind a magic; the bytes before a file's first one (none, in a sound file) are the first piece.
    totals = checkpointed(pieces.groupBy("file", "split").agg(F.sum("size").alias("bytes")))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", "split", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base"))
    pieces = pieces.join(F.broadcast(base) if totals.count() <= BROADCAST_ROWS else base, ["file", "split"])
    # A piece at p follows the magic at p - len(MAGIC), where its record starts.
    placed = pieces.withColumns({"at": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next")}).where("at >= 0")
    nodes = checkpointed(placed.select("file", "split", "at", "next", F.col("digest").isNull().alias("open")))
    known = reachable(nodes.where("next IS NOT NULL").select("file", "split", "at", "next"))
    records = placed.join(known, ["file", "at"])
    whole = records.where("digest IS NOT NULL")
    # Payloads that were cut at a magic: their pieces are those up to the next record.
    if not nodes.where("open").take(1):
        cut = whole.limit(0)
    else:
        # The record before each piece: of its split, else the last one of the splits before (a row a split is carried on).
        upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        inside = checkpointed(nodes.join(known.select("file", "at", F.col("at").alias("own")), ["file", "at"], "left").select("file", "split", "at", "open", "own", F.last("own", ignorenulls=True).over(upto).alias("first")))
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        carried = inside.groupBy("file", "split").agg(F.max("own").alias("own")).select("file", "split", F.last("own", ignorenulls=True).over(earlier).alias("carried"))
        marked = inside.join(carried, ["file", "split"]).select("file", "at", "open", "own", F.coalesce("first", "carried").alias("first"))
        torn = marked.where("own IS NOT NULL AND open").select("file", "first")
        owned = placed.join(marked.join(torn, ["file", "first"], "left_semi").select("file", "at", "first"), ["file", "at"])
        joined = owned.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("parts"))
        bytes_ = F.array_join(F.transform("parts", lambda p: F.hex(p["body"])), MAGIC.encode().hex().upper())
        content = joined.select(F.col("file"), F.col("first").alias("at"), F.unhex(bytes_).alias("content"))
        cut = records.where("digest IS NULL").join(content, ["file", "at"])
        cut = cut.withColumn("digest", F.sha1(F.substring("content", (F.col("head") - len(MAGIC) + 1).cast("int"), F.col("declared").cast("int")))).select(*whole.columns)
    ident = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1), '') AS BIGINT)")
    return whole.union(cut).select("file", "at", F.col("kind").alias("record_type"), "target", ident("page").alias("page_id"), ident("refers").alias("refers_to"), F.col("declared").alias("payload_bytes"), F.col("digest").alias("payload_digest"))


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
SELECT p.page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
       CASE WHEN first IS NOT NULL AND p.page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND p.page_id <> first THEN first END AS refers_to
FROM pages p LEFT JOIN (
  SELECT coalesce(html, '') AS body, max(page_id) AS first FROM pages WHERE strlen(coalesce(html, '')) >= 1000 GROUP BY 1 HAVING count(*) > 1) r
ON coalesce(p.html, '') = r.body
"""
