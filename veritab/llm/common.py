"""What the operators of this subpackage share: shared scratch tables, bounded batches, splits."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text, and their bytes, that go to a Python worker at once; keeps a worker's memory apart from the table's size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers that see this folder import the package, wherever the driver was started.

    On a cluster whose executors do not see it, the package goes along with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it is unset: a temporary folder in local mode, an error on a cluster."""
    importable(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="veritab-")  # driver and tasks are one process
        spark.conf.set("spark.checkpoint.dir", where)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Hands texts to Python workers in batches of at most BATCH_ROWS rows and, but for single rows, BATCH_BYTES."""
    importable(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).rstrip("bB")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(key, str(most))


def carried(docs: DataFrame, *without: str) -> tuple[Column, list[Column]]:
    """docs' columns but those called like without, in any case, as one struct to be called row; what takes them out of it again.

    Beside row an operator's own names meet no name of the caller's.
    """
    apart = {x.lower() for x in without}
    kept = [c for c in docs.columns if c.lower() not in apart]
    row = F.struct(F.lit(0).alias("rows"), *[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(kept)])
    return row.alias("row"), [F.col(f"row.c{k}").alias(c) for k, c in enumerate(kept)]


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; 0..modulus-1, null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def partitions_of(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


#: A key is hot with more rows than this, and more than one in HOTS of all rows: HOTS hot keys at most.
HOT_ROWS, HOTS = 256, 100_000
#: Rows that are joined as they are: one task may have all of them.
EASY_ROWS = 50_000


def hot_keys(rows: DataFrame, key: str, total: int) -> DataFrame:
    """(key, rows) of the hot keys of rows, which has total rows: HOTS keys at most, whatever the data."""
    counts = rows.groupBy(key).agg(F.count("*").alias("rows"))
    return checkpointed(counts.where((F.col("rows") > max(HOT_ROWS, total // HOTS)) & F.col(key).isNotNull()))


#: Rows of two numbers that a partition may have.
LINKS = 1 << 20


def few(links: DataFrame, rows: int) -> DataFrame:
    """links, of which there are that many, in as many partitions as they need: small tables leave few files, and one partition no shuffle."""
    return links.coalesce(max(1, -(-rows // LINKS)))


def looked_up(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has a row a key: rows of hot keys stay where they are, all others are shuffled.

    total: about how many rows there are. how: inner or left.
    """
    if total <= EASY_ROWS:
        return rows.join(table, key, how)
    hot = hot_keys(rows, key, total).select(key)
    if not hot.take(1):
        return rows.join(table, key, how)
    side = F.broadcast(hot)  # HOTS keys at most, and so are the table's rows of them
    few = F.broadcast(table.join(side, key, "left_semi"))
    return rows.join(side, key, "left_semi").join(few, key, how).unionByName(rows.join(side, key, "left_anti").join(table, key, how))
