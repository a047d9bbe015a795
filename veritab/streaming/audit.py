"""Streams: the audit log as it grows, and new documents that re-open the concepts they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.model import AUDIT_EVENTS, PARAGRAPHS


#: Parts of each batch of the store, by hashes of concepts.
PARTS = 64


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(AUDIT_EVENTS).json(path)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; later ones than the watermark are left out."""
    at = events.withColumn("at", F.to_timestamp("timestamp"))
    return at.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "eventType").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "eventType", "n")


def paragraph_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(PARAGRAPHS).parquet(path)


def on_new_paragraphs(stream: DataFrame, store: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Facts of new paragraphs go to store, once each; concepts that they touch are compared again and given to sink.

    The store is partitioned by batch and by a hash of the concept, so a batch reads the parts of
    the concepts that it touches; a batch that runs again replaces itself.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        facts = analyse(rows).withColumn("part", F.pmod(F.xxhash64("conceptKey"), F.lit(PARTS)).cast("int"))
        facts.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        own = spark.read.option("basePath", store).parquet(f"{store}/batch={number}")
        touched = own.select("conceptKey", "part").distinct()
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # PARTS at most
        everything = spark.read.parquet(store).where(F.col("part").isin(parts))
        sink(everything.join(touched.select("conceptKey"), "conceptKey", "left_semi").drop("part"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
