"""Consensus kept up to date: what documents settle on, as facts arrive.

Every fact counts once, however often it comes. What a batch brings is summed up where it was read,
then folded into the state of its (concept, document): for each value its counts and first place, with
and without downgraded facts. A key of most facts costs a batch its distinct values in each task, and
the state grows with distinct values, not with facts. A key whose verdict a batch does not change gives
no row. Facts may come late, again, and in any division into batches: counts and first places do
not depend on order, so the last row of each key equals relational.consensus over all facts.

Verdicts of concepts follow from the last rows of their documents, kept by parts of concepts' hashes;
a batch reads the parts that it touches, and one that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Parts of each batch of the store, by hashes of concepts.
PARTS = 64
KEY = ["conceptKey", "documentId"]
SETTLED = "conceptKey string, documentId string, consensus string, values long, facts long, benign string"
COUNTS = "conceptKey string, documentId string, value string, n long, first long, n_all long, first_all long, mitigates boolean"
STATE = "value array<string>, n array<long>, first array<long>, n_all array<long>, first_all array<long>, mitigates array<boolean>"


def settled(facts: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of facts (conceptKey, documentId, normalizedValue, entitySeq, benign) as changes of what documents settle on.

    watermark: a column and a delay, "column,delay", after which facts no longer come again; without
    one the ids of all facts are kept. Facts are told apart by concept, document and entitySeq.
    """
    own = facts.select(*KEY, F.col("normalizedValue").alias("value"), F.col("entitySeq").alias("seq"), F.coalesce(F.col("benign.mode"), F.lit("")).alias("mode"), *([watermark.split(",")[0]] if watermark else []))
    if watermark:
        column, delay = watermark.split(",")
        once = own.withWatermark(column, delay).dropDuplicatesWithinWatermark([*KEY, "seq"])
    else:
        once = own.dropDuplicates([*KEY, "seq"])
    return once.select(*KEY, "value", "seq", "mode").mapInPandas(_summed(), COUNTS).groupBy(*KEY).applyInPandasWithState(_folded(), SETTLED, STATE, "append", GroupStateTimeout.NoTimeout)


def _summed():
    """Counts of each (concept, document, value) of a batch of rows."""

    def run(batches):
        for rows in batches:
            if not len(rows):
                continue
            kept = rows["mode"] != "downgrade"
            rows = rows.assign(n=kept.astype("int64"), first=rows["seq"].where(kept), mitigates=rows["mode"] == "mitigate")
            keys = ["conceptKey", "documentId", "value"]
            out = rows.groupby(keys, dropna=False).agg(n=("n", "sum"), first=("first", "min"), n_all=("seq", "size"), first_all=("seq", "min"), mitigates=("mitigates", "any")).reset_index()
            yield out.assign(first=out["first"].astype("Int64"))

    return run


def _folded():
    """Folds counts into a key's state; a row if its verdict is another one than before."""

    def verdict(held: dict) -> tuple:
        firm = {v: x for v, x in held.items() if x[0]}
        if firm:
            best = min(firm, key=lambda v: (-firm[v][0], firm[v][1]))
        else:
            best = min(held, key=lambda v: (-held[v][2], held[v][3]))
        lowered = any(x[2] > x[0] for x in held.values())
        benign = "downgrade" if lowered and len(firm) < 2 else "mitigate" if any(x[4] for x in held.values()) else "none"
        return best, len([v for v in held if v is not None]), sum(x[2] for x in held.values()), benign

    def fold(key, batches, state):
        import pandas as pd

        held = {}
        if state.exists:
            value, n, first, n_all, first_all, mitigates = state.get
            held = {v: (a, b, c, d, e) for v, a, b, c, d, e in zip(value, n, first, n_all, first_all, mitigates, strict=True)}
        before = verdict(held) if held else None
        for rows in batches:
            for v, n, first, n_all, first_all, mitigates in rows[["value", "n", "first", "n_all", "first_all", "mitigates"]].itertuples(index=False):
                v, first = (None if pd.isna(v) else v), (None if pd.isna(first) else int(first))
                a, b, c, d, e = held.get(v, (0, None, 0, None, False))
                least = lambda x, y: y if x is None else x if y is None else min(x, y)
                held[v] = (a + int(n), least(b, first), c + int(n_all), least(d, int(first_all)), bool(e or mitigates))
        state.update(([*held], *[[x[k] for x in held.values()] for k in range(5)]))
        now = verdict(held)
        if now != before:
            yield pd.DataFrame([(*key, *now)], columns=["conceptKey", "documentId", "consensus", "values", "facts", "benign"])

    return fold


def drifts(rows: DataFrame) -> DataFrame:
    """(conceptKey, documents, variants, drifting, within): verdicts of concepts from what their documents settle on."""
    kept = F.col("consensus").isNotNull()
    out = rows.groupBy("conceptKey").agg(F.count_if(kept).alias("documents"), F.count_distinct(F.when(kept, F.col("consensus"))).alias("variants"), F.count_if(F.col("values") >= 2).alias("within"))
    return out.select("conceptKey", "documents", "variants", ((F.col("documents") >= 2) & (F.col("variants") >= 2)).alias("drifting"), "within")


def latest(store: DataFrame) -> DataFrame:
    """The last row of each (concept, document) of a store of changes."""
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("batch")))  # a key has a row a batch at most
    return store.withColumn("_n", last).where("_n = 1").drop("_n", "batch", "part")


def keep_verdicts(facts: DataFrame, store: str, checkpoint: str, sink: Callable[[DataFrame, int], None], watermark: str | None = None):
    """Runs over what there is of a stream of facts: changes go to store, and verdicts of the concepts that they touch to sink."""
    spark = facts.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64("conceptKey"), F.lit(PARTS)).cast("int")
        rows.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{store}/batch={number}")
        everything = spark.read.schema(f"{SETTLED}, batch long, part int").option("basePath", store).parquet(store)
        touched = everything.where(F.col("batch") == number).select("conceptKey", "part").distinct()
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # PARTS at most
        own = everything.where(F.col("part").isin(parts) & (F.col("batch") <= number))
        sink(drifts(latest(own).join(touched.select("conceptKey"), "conceptKey", "left_semi")), number)

    return settled(facts, watermark).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
