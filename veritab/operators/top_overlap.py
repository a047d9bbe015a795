"""The best match of described things among many: an inverted index of tokens, searched from the rarest token on.

A description of k tokens scores a thing by how many of them begin, or are begun by, one of the
thing's tokens. A thing that holds none of the m rarest tokens scores no more than the rest together.
So descriptions look at the things of their rarest token, then of the next, and end once their best
beats all that the tokens left could give: lists of frequent tokens are read for those descriptions
alone that nothing rarer settles. Where one token is left, the first thing of its list is enough: what
holds a rarer one too was seen before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.operators import relational
from veritab.operators.prefixes import prefix_pairs


def best_by_overlap(asks: DataFrame, held: DataFrame) -> DataFrame:
    """(key, subject, seq, score): for each distinct (key, subject) of asks the thing of held (key, seq, tokens) with its key, of the greatest score, the first of ties; none where nothing scores."""
    asks = relational.cut(asks.select("key", "subject").where(F.size("subject") > 0).distinct().withColumn("ask", F.monotonically_increasing_id()))
    things = relational.cut(held.where(F.size("tokens") > 0).groupBy("key", "tokens").agg(F.min("seq").alias("seq")))  # of equal ones the first
    lists = relational.cut(things.select("key", "seq", F.explode(F.array_distinct("tokens")).alias("h")))
    words = asks.select("ask", "key", F.explode("subject").alias("t")).groupBy("ask", "key", "t").agg(F.count("*").alias("w"))
    pairs = relational.cut(prefix_pairs(words.select(F.col("t").alias("x")).distinct(), lists.select(F.col("h").alias("x")).distinct()).select(F.col("l").alias("t"), F.col("r").alias("h")))
    sizes = lists.groupBy("key", "h").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    # Tokens in the order of their lists; those that no thing has drop out.
    own = words.join(pairs, "t").join(sizes.select("key", "h", "n"), ["key", "h"]).groupBy("ask", "key", "t", "w").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("ask").orderBy("n", "t")  # a description's tokens
    own = own.withColumns({"place": F.row_number().over(order), "rest": F.coalesce(F.sum("w").over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))})
    own = relational.cut(own.select("ask", "key", "t", "place", "rest"))
    open_, best, place = own, None, 1
    while open_.take(1):
        now = relational.cut(open_.where(F.col("place") == place).select("ask", "key", "t", "rest").join(pairs, "t"))
        seen = relational.met_by(now.where("rest > 0").withColumn("at", F.struct("key", "h")).select("ask", "rest", "at"), _by_list(lists), "at").select("ask", "seq", "rest")
        last = now.where("rest = 0").join(sizes, ["key", "h"]).select("ask", "seq", "rest")
        found = relational.cut(seen.union(last).distinct().join(asks, "ask").join(things.select("key", "seq", "tokens"), ["key", "seq"]).select("ask", "seq", "rest", S.overlap(F.col("subject"), F.col("tokens")).alias("score")))
        each = found.select("ask", "seq", "score")
        each = each if best is None else best.unionByName(each)
        best = relational.cut(each.groupBy("ask").agg(F.max_by(F.struct("seq", "score"), F.struct("score", -F.col("seq"))).alias("b")).select("ask", "b.seq", "b.score"))
        settled = own.where(F.col("place") == place).select("ask", "rest").join(best, "ask").where((F.col("score") > F.col("rest")) | (F.col("rest") == 0)).select("ask")
        open_ = relational.cut(open_.where(F.col("place") > place).join(settled, "ask", "left_anti"))
        place += 1
    if best is None:
        return asks.where("false").select("key", "subject", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("int").alias("score"))
    return best.join(asks, "ask").select("key", "subject", "seq", "score")


def _by_list(lists: DataFrame) -> DataFrame:
    return lists.select(F.struct("key", "h").alias("at"), "seq")
