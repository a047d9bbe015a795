"""Sources: descriptors, positioned items, binary documents, golden manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.model import DESCRIPTORS, ITEMS, chosen
from veritab.operators import relational

#: How a document's type shows in its file name, in the order in which it is tried.
TYPES = [("(?i)sap", "SAP"), ("(?i)csr", "CSR"), ("(?i)crf", "CRF"), ("(?i)brochure|ib", "IB")]
MANIFEST = "id string, summary string, kind string, severity string, conceptKey string, scope string, evidence string, arithmetic string, resolvedCrossReferences int"


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of descriptors, with docSeq: the order of their ids in the list."""
    rows = spark.read.schema(DESCRIPTORS).option("multiLine", True).json(path)
    return with_order(rows)


def with_order(rows: DataFrame) -> DataFrame:
    """Descriptors with docSeq, in the order of rows."""
    placed = relational.cut(rows.withColumn("_i", F.monotonically_increasing_id()))
    return relational.dense_numbers(placed, ["_i"], "docSeq").withColumn("docSeq", (F.col("docSeq") - 1).cast("int")).drop("_i")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned text items as Parquet, or JSON lines if the path says so."""
    return spark.read.schema(ITEMS).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(ITEMS).parquet(path)


def document_type(file_name: Column) -> Column:
    return chosen(file_name, TYPES, F.lit("PROTOCOL"))


def corpus_files(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Descriptors joined with the bytes of the files that they name: of several files of a name in different folders the first by path. A missing file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = wanted.select("fileName").distinct().withColumn("_base", base("fileName"))
    ends = F.endswith("_path", F.concat(F.lit("/"), F.col("fileName")))
    first = names.join(files.select(F.col("path").alias("_path"), base("path").alias("_base")), "_base").where(ends).groupBy("fileName").agg(F.min("_path").alias("_path"))
    missing = wanted.join(first, "fileName", "left_anti").select("fileName").limit(10).collect()
    if missing:
        raise FileNotFoundError(f"no file for {[r[0] for r in missing]}")
    return wanted.join(first, "fileName").join(files.select(F.col("path").alias("_path"), "content"), "_path").drop("_path")


def found_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below path as descriptors, their types taken from their names; none is no error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("id"), document_type(name).alias("type"), name.alias("fileName"), name.alias("title"), F.lit("").alias("version"), F.lit("").alias("effectiveDate"), F.lit("").alias("author"), "content")


def decoded(files: DataFrame, decoder: Callable[[bytes], list[list[dict]]]) -> DataFrame:
    """Positioned items of binary documents. decoder is pluggable: bytes to pages of items (text, x, y, width, height, rotation, fontFamily)."""
    import pandas as pd

    names = ["text", "x", "y", "width", "height", "rotation", "fontFamily"]

    def run(batches):
        for pdf in batches:
            out = []
            for doc, content in zip(pdf["id"], pdf["content"], strict=True):
                for page, own in enumerate(decoder(bytes(content)), start=1):
                    out += [{"documentId": doc, "pdfPage": page, "itemSeq": k, **{n: i.get(n) for n in names}} for k, i in enumerate(own) if str(i.get("text", "")).strip()]
            yield pd.DataFrame(out, columns=["documentId", "pdfPage", "itemSeq", *names])

    return files.select("id", "content").mapInPandas(run, ITEMS)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)
