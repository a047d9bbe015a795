"""Segmented scans: what stands before a row of a key, however many rows the key has.

Rows are dealt into ranges of (key, order). Each range is scanned alone; its keys' totals are
transitions (sums, and the last value seen), and only keys that reach over a range's end need those of
earlier ranges: two keys a range at most, so what meets in one place is as much as there are
partitions. No task has to hold all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.operators import relational

#: Rows up to which a window by key does the same: one task may have all of them.
EASY_ROWS = 50_000


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Sequence[str] = (), lasts: Sequence[str] = ()) -> DataFrame:
    """df with before_<c>, the sum of c over the earlier rows of its key (0 for none), for each c of sums; and last_<c>, the last c among them that is not null, for each of lasts.

    (keys, order) name one row each; keys are not null.
    """
    keys, order = list(keys), list(order)
    rows = relational.cut(df)
    earlier = lambda *part: Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if rows.count() <= EASY_ROWS:
        w = earlier(*keys)
        return rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums} | {f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in lasts})
    ranged = relational.cut(rows.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    w = earlier("_p", *keys)
    own = ranged.withColumns({f"before_{c}": F.sum(c).over(w) for c in sums} | {f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in lasts})
    place = F.struct(*order)
    totals = ranged.groupBy("_p", *keys).agg(F.lit(1).alias("_one"), *[F.sum(c).alias(f"_{c}") for c in sums], *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_{c}") for c in lasts])
    beyond = totals.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys)  # keys of several ranges
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.join(beyond, keys, "left_semi").select("_p", *keys, *[F.sum(f"_{c}").over(w).alias(f"_{c}") for c in sums], *[F.last(f"_{c}", ignorenulls=True).over(w).alias(f"_{c}") for c in lasts])
    out = own.join(F.broadcast(carried), ["_p", *keys], "left")  # two rows a range at most
    out = out.withColumns({f"before_{c}": F.coalesce(f"before_{c}", F.lit(0)) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {f"last_{c}": F.coalesce(f"last_{c}", f"_{c}") for c in lasts})
    return out.drop("_p", *[f"_{c}" for c in (*sums, *lasts)])


def numbered_within(df: DataFrame, key: str, order: Sequence[str], out: str) -> DataFrame:
    """df with each row's place among the rows of its key, from 1, in a total order."""
    rows = relational.cut(relational.dense_numbers(df, [key, *order], "_number"))
    first = rows.groupBy(key).agg(F.min("_number").alias("_first"))
    return relational.looked_up(rows, first, key).withColumn(out, (F.col("_number") - F.col("_first") + 1).cast("long")).drop("_number", "_first")
