"""Tables between steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset: a temporary folder in local mode, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="veritab-")  # driver and tasks are one process
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of parts as one table, written part by part: each part is planned alone."""
    spark, path = None, None
    for part in parts:
        if path is None:
            spark = part.sparkSession
            path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored_by(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows as a table with a folder for each value of column, of which there are few."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(column).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
