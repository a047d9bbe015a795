"""Order-aware relational operators over facts, generic in their column names.

Each one is a few aggregations or joins on its keys. Ties are settled by explicit sequence
columns, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.matches import let


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row by order of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def consensus(df: DataFrame, keys: Sequence[str], value: str, seq: str | Column, downgraded: Column | None = None, out: str = "consensus") -> DataFrame:
    """(keys, out): the most frequent value; of equally frequent ones the one seen first.

    Rows that are downgraded count only where a key has no others. Two aggregations; the value
    counts are pre-aggregated, so a frequent key costs no more than its distinct values.
    """
    low = F.lit(False) if downgraded is None else F.coalesce(downgraded, F.lit(False))
    seq = F.col(seq) if isinstance(seq, str) else seq
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count_if(~low).alias("_c"), F.min(F.when(~low, seq)).alias("_s"), F.count("*").alias("_ca"), F.min(seq).alias("_sa"))
    best = counts.groupBy(*keys).agg(F.max_by("_v", F.when(F.col("_c") > 0, F.struct(F.col("_c").alias("c"), (-F.col("_s")).alias("s")))).alias("_b"), F.max_by("_v", F.struct(F.col("_ca").alias("c"), (-F.col("_sa")).alias("s"))).alias("_all"))
    return best.select(*keys, F.coalesce("_b", "_all").alias(out))


def disagreeing(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n_values) of keys with at least two distinct values."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).where("n_values >= 2")


def cross_drift(df: DataFrame, concept: str, document: str, value: str, seq: str | Column, downgraded: Column | None = None) -> DataFrame:
    """(concept, document, consensus) of concepts whose documents settle on at least two values."""
    settled = consensus(df, [concept, document], value, seq, downgraded).where("consensus IS NOT NULL")
    several = settled.groupBy(concept).agg(F.count("*").alias("_d"), F.count_distinct("consensus").alias("_v")).where("_d >= 2 AND _v >= 2").select(concept)
    return settled.join(several, concept, "left_semi")


def benign_mode(df: DataFrame, keys: Sequence[str], value: str, mode: Column) -> DataFrame:
    """(keys, benign): downgrade if the rest holds fewer than two values, else mitigate if any row does, else none."""
    down = F.coalesce(mode == "downgrade", F.lit(False))
    g = df.groupBy(*keys).agg(F.bool_or(down).alias("_d"), F.count_distinct(F.when(~down, F.col(value))).alias("_r"), F.bool_or(F.coalesce(mode == "mitigate", F.lit(False))).alias("_m"))
    return g.select(*keys, F.when(F.col("_d") & (F.col("_r") < 2), "downgrade").when(F.col("_m"), "mitigate").otherwise("none").alias("benign"))


def uncovered(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left without a counterpart in right."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def prefix_lookup(df: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """df with the value of the first row (by ord) of table (prefix, ord, value) whose prefix starts key.

    table is a small declared dimension, so it is broadcast.
    """
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    met = tagged.select("_id", key).join(F.broadcast(table), F.col(key).startswith(F.col("prefix"))).groupBy("_id").agg(F.min_by("value", "ord").alias("value"))
    return tagged.join(met, "_id", "left").drop("_id")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, out: str = "island") -> DataFrame:
    """df with a running number of the stretch that each row belongs to; starts may use lag over the same order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_s", F.coalesce(starts, F.lit(False))).withColumn(out, F.sum(F.col("_s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def anchored(values: Column, reach: float) -> Column:
    """Bucket number of each sorted value: a value joins the open bucket if it is within reach of its first one.

    For arrays of bounded length (the items of a page); anchored_rows does the same for groups of any size.
    """
    start = F.struct(F.array().cast("array<double>").alias("firsts"))
    last = lambda a: F.element_at(a, -1)
    opens = lambda a, v: (F.size(a["firsts"]) == 0) | (v > F.when(F.size(a["firsts"]) > 0, last(a["firsts"])) + reach)
    firsts = F.aggregate(values, start, lambda a, v: F.when(opens(a, v), F.struct(F.concat(a["firsts"], F.array(v)).alias("firsts"))).otherwise(a), lambda a: a["firsts"])
    return let({"firsts": firsts, "values": values}, lambda o: F.transform(o["values"], lambda v: F.size(F.filter(o["firsts"], lambda x: x <= v))))


def anchored_rows(df: DataFrame, keys: Sequence[str], value: str, reach: float, out: str = "bucket") -> DataFrame:
    """df's distinct (keys, value) with the number of the bucket that the value is in, counted from 1 in each key.

    A bucket's first value leads to the next bucket's: the first value beyond its reach. That is a
    chain over the distinct values, and only what it reaches from a key's least value starts a
    bucket; pointer doubling finds that in as many rounds as a chain's length has binary digits.
    A hot key costs its distinct values, not its rows.
    """
    keys = list(keys)
    rows = cut(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")).distinct())
    # Values and the ends of their reaches in one order, downwards: what a reach leads to was seen last.
    ends = rows.select(*keys, F.col("_v").alias("_from"), (F.col("_v") + reach).alias("_at"), F.lit(None).cast("double").alias("_value"))
    places = ends.unionByName(rows.select(*keys, F.lit(None).cast("double").alias("_from"), F.col("_v").alias("_at"), F.col("_v").alias("_value")))
    down = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.col("_value").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    jumps = cut(places.withColumn("_to", F.last("_value", ignorenulls=True).over(down)).where("_from IS NOT NULL").select(*keys, F.col("_from").alias("_v"), "_to"))
    reached = cut(rows.groupBy(*keys).agg(F.min("_v").alias("_v")))
    while True:
        more = reached.join(jumps, [*keys, "_v"]).where("_to IS NOT NULL").select(*keys, F.col("_to").alias("_v"))
        grown = cut(reached.union(more).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        beyond = jumps.select(*keys, F.col("_v").alias("_to"), F.col("_to").alias("_next"))
        jumps = cut(jumps.join(beyond, [*keys, "_to"], "left").select(*keys, "_v", F.col("_next").alias("_to")))
    w = Window.partitionBy(*keys).orderBy("_v")
    marked = rows.join(reached.withColumn("_first", F.lit(1)), [*keys, "_v"], "left")
    return marked.select(*keys, F.col("_v").alias(value), F.sum(F.coalesce("_first", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(out))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of undirected edges (a, b): the smallest node of each component, by propagating minima until nothing changes.

    Every round also jumps to the root's root, so rounds grow slowly with a component's length.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("m"))
        grown = cut(labels.join(near, labels.node == near.a, "left").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was")))
        jump = grown.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        moved = cut(looked_up(grown, jump, "root", "left").select("node", F.least("root", F.coalesce("r2", "root")).alias("root"), "was"))
        labels = moved.select("node", "root")
        if not moved.where("root <> was").take(1):
            return labels


#: A key is hot with more rows than this, and more than one in HOTS of all rows: HOTS hot keys at most.
HOT_ROWS, HOTS = 1024, 100_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows (a stored table) joined with table, which has a row a key; rows of hot keys stay where they are."""
    counts = rows.groupBy(key).agg(F.count("*").alias("_n"))
    hot = cut(counts.where((F.col("_n") > max(HOT_ROWS, rows.count() // HOTS)) & F.col(key).isNotNull()).select(key))
    if not hot.take(1):
        return rows.join(table, key, how)
    side = F.broadcast(hot)  # HOTS keys at most, and so are the table's rows of them
    few = F.broadcast(table.join(side, key, "left_semi"))
    return rows.join(side, key, "left_semi").join(few, key, how).unionByName(rows.join(side, key, "left_anti").join(table, key, how))


#: Rows of a task where a row takes long: tables of few bytes are read by few tasks, however many rows they have.
DEALT_ROWS = 10_000


def dealt(df: DataFrame) -> DataFrame:
    """df's rows dealt over tasks of about DEALT_ROWS, for work that costs by the row and not by the byte.

    Spark moves conditions on what is made of dealt rows to before the shuffle, where few tasks would work
    them out; a condition on the task's own number, which always holds, keeps them behind it.
    """
    own = df.repartition(max(1, -(-df.count() // DEALT_ROWS)))
    return own.withColumn("_task", F.spark_partition_id()).where("_task >= 0").drop("_task")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    from veritab.plans.scratch import shared_dir

    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def met_by(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left joined with right (a stored table) by key, which both may repeat: right's rows of a hot key are dealt over salts, for which left's rows of it repeat."""
    most = max(HOT_ROWS, right.count() // HOTS)
    hot = cut(right.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("_salts")).where(F.col("_salts") > 1))
    if not hot.take(1):
        return left.join(right, key)
    side = F.broadcast(hot)  # HOTS keys at most
    salts = F.coalesce("_salts", F.lit(1))
    dealt = right.join(side, key, "left").withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).drop("_salts")
    again = left.join(side, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return again.join(dealt, [key, "_salt"]).drop("_salt")


def similar_pairs(df: DataFrame, node: str, tokens: str, least: float) -> DataFrame:
    """Edges (a, b) that join the nodes whose tokens are similar: the share of the earlier node's tokens that prefix-match.

    A left node of n tokens needs matches for at least least * n of them, so one of its
    n - ceil(least * n) + 1 rarest tokens must match: only those look for partners, and meet all
    tokens that they begin or that begin them (prefixes.prefix_pairs). Nodes of equal tokens are
    joined with the first of them, which alone meets others (as the earlier one, if any of its nodes
    is before any of the others).
    """
    from veritab.operators.prefixes import prefix_pairs

    nodes = cut(df.select(F.col(node).alias("n"), F.col(tokens).alias("t")).where(F.size("t") > 0))
    t = cut(nodes.groupBy("t").agg(F.min("n").alias("n"), F.max("n").alias("last")))
    each = cut(t.select("n", "last", F.explode(F.array_distinct("t")).alias("x"), F.size("t").alias("k")))
    common = cut(each.groupBy("x").agg(F.count("*").alias("c")))
    rank = F.row_number().over(Window.partitionBy("n").orderBy("c", "x"))
    probes = looked_up(each, common, "x").withColumn("r", rank).where(F.col("r") <= F.col("k") - F.ceil(least * F.col("k")) + 1).select(F.col("n").alias("a"), F.col("x").alias("l"))
    probes = cut(probes)
    pairs = prefix_pairs(probes.select(F.col("l").alias("x")).distinct(), common)
    asked = met_by(pairs, probes, "l").select("a", F.col("r").alias("x"))
    met = met_by(asked, each.select("x", F.col("n").alias("b"), "last"), "x").where((F.col("a") != F.col("b")) & (F.col("a") < F.col("last")))
    met = cut(met.select("a", "b").distinct())
    met = looked_up(met, t.select(F.col("n").alias("a"), F.col("t").alias("lt")), "a")
    met = looked_up(cut(met), t.select(F.col("n").alias("b"), F.col("t").alias("rt")), "b")
    shared = F.size(F.filter("lt", lambda x: F.exists("rt", lambda y: x.startswith(y) | y.startswith(x))))
    copies = looked_up(nodes, t.select("t", F.col("n").alias("a")), "t").where("a <> n").select("a", F.col("n").alias("b"))
    return met.where(shared / F.size(F.array_union("lt", "rt")) >= least).select("a", "b").union(copies)


def most_shared(subjects: DataFrame, subject: str, token: str, weight: str, others: DataFrame, other: str, name: str) -> DataFrame:
    """(subject, other, shared): for each subject the other with which it shares most; tokens are shared if one starts the other.

    subjects: a row for each token, with its weight; others: a row for each token. Vocabularies meet
    first; a pair of a token and an other counts once however many tokens it meets by.
    """
    from veritab.operators.prefixes import prefix_pairs

    held = cut(others.select(F.col(other), F.col(name).alias("r")).distinct())
    pairs = cut(prefix_pairs(subjects.select(F.col(token).alias("x")).distinct(), held.select(F.col("r").alias("x")).distinct()))
    met = met_by(pairs, held, "r").select(F.col("l").alias("t"), other).distinct()
    sums = subjects.join(met, subjects[token] == met["t"]).groupBy(subject, other).agg(F.sum(weight).alias("shared"))
    return sums.groupBy(subject).agg(F.min_by(F.struct(other, "shared"), F.struct(-F.col("shared"), other)).alias("b")).select(subject, f"b.{other}", "b.shared")


def dense_numbers(df: DataFrame, order: Sequence[Column | str], out: str = "number") -> DataFrame:
    """df with its rows' places in a total order, from 1; keys are ascending (numbers are negated to sort downwards), nulls first.

    Rows are dealt into ranges of the order and counted in each range; only the ranges' counts, as
    many as there are partitions, meet in one task.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    plain = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys, strict=True)])
    ranged = cut(plain.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()))
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a partition
    return own.join(F.broadcast(before), "_p").withColumn(out, (F.col("_b") + F.col("_n")).cast("long")).drop("_p", "_n", "_b", *keys)


def dense_ids(df: DataFrame, order: Sequence[Column | str], prefix: str, width: int, out: str = "id") -> DataFrame:
    """df with ids prefix-0001.. in a total order."""
    text = F.col("_number").cast("string")
    return dense_numbers(df, order, "_number").withColumn(out, F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))).drop("_number")
