"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINKS, checkpointed, few, looked_up


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    Links stay a table with as many partitions as its rows need; each round leaves a checkpoint in
    the shared folder, and the number of rounds grows with the logarithm of the longest chain. Null
    ends and self links do nothing; no link gives an empty table.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    e = checkpointed(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = None
    while (now := _state(e)) != was and now[0]:
        was, e = now, few(e, now[0])
        n = now[0] if now[0] > LINKS else 0  # one partition is joined as it is
        both = e.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = few(looked_up(both, least, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b"), now[0]).distinct()
        large = checkpointed(large) if n else large
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = looked_up(large, least, "a", n).select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))))
        e = checkpointed(few(small.where("a > b"), now[0]).distinct())
    return e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root"))))).distinct()
