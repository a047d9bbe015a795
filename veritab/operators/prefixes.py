"""Tokens of which one begins the other, met as intervals of a sorted vocabulary.

In the order of their bytes, the tokens that begin with a token stand together, right behind it: they
are an interval of places. Its end is found by sorting a mark in with the tokens, the token with a byte
behind it that no text holds. So "starts with" is containment of a place in an interval, and that is
joined by bins of places: a place is in one bin, an interval in as many as it covers. Work is linear in
tokens and in the pairs found; no token is cut into its prefixes, however long it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators import relational

#: Places of a bin. A place is compared with the intervals that begin in its bin, this many at most, and with those around it, which hold it.
BIN = 64


def intervals(words: DataFrame, token: str = "x") -> DataFrame:
    """words (stored, a row a token) with low, the token's place in the vocabulary, and high, the first place beyond the tokens that begin with it."""
    rows = relational.cut(words.withColumn("_id", F.monotonically_increasing_id()))
    own = F.col(token).cast("binary")
    places = rows.select("_id", own.alias("_k"), F.lit(0).alias("_mark")).union(rows.select("_id", F.concat(own, F.lit(b"\xff")), F.lit(1)))
    places = relational.dense_numbers(places, ["_k"], "_at").select("_id", "_mark", "_at")
    ends = places.groupBy("_id").agg(F.min(F.when(F.col("_mark") == 0, F.col("_at"))).alias("low"), F.min(F.when(F.col("_mark") == 1, F.col("_at"))).alias("high"))
    return rows.join(ends, "_id").drop("_id")


def prefix_pairs(left: DataFrame, right: DataFrame, token: str = "x") -> DataFrame:
    """(l, r): each token of left with each token of right that it begins, or that begins it; equal ones too. Null and empty tokens meet none."""
    one = left.select(F.col(token).alias("x"), F.lit(True).alias("l"), F.lit(False).alias("r"))
    other = right.select(F.col(token).alias("x"), F.lit(False).alias("l"), F.lit(True).alias("r"))
    words = one.union(other).where("x <> ''").groupBy("x").agg(F.bool_or("l").alias("l"), F.bool_or("r").alias("r"))
    placed = relational.cut(intervals(words))
    bin_of = lambda c: F.floor(c / BIN)
    outer = placed.select(F.col("low").alias("first"), "high", F.col("l").alias("ol"), F.col("r").alias("or"), F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high") - 1))).alias("bin"))
    inner = placed.select(F.col("low").alias("at"), F.col("l").alias("il"), F.col("r").alias("ir"), bin_of(F.col("low")).alias("bin"))
    held = outer.join(inner, "bin").where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("high")))
    ways = F.array(F.when(F.col("ol") & F.col("ir"), F.struct(F.col("first").alias("l"), F.col("at").alias("r"))), F.when(F.col("or") & F.col("il") & (F.col("at") != F.col("first")), F.struct(F.col("at").alias("l"), F.col("first").alias("r"))))
    pairs = held.select(F.inline(F.filter(ways, lambda p: p.isNotNull())))
    names = lambda c: placed.select(F.col("low").alias(c), F.col("x").alias(f"_{c}"))
    return pairs.join(names("l"), "l").join(names("r"), "r").select(F.col("_l").alias("l"), F.col("_r").alias("r"))
