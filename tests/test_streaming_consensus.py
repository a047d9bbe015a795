"""Consensus over a stream equals that over all facts, however they are divided, late or repeated."""

import random

import pytest
from pyspark.sql import functions as F

from veritab.operators import relational
from veritab.streaming import consensus

FACTS = "conceptKey string, documentId string, normalizedValue string, entitySeq long, benign struct<patternId:string,mode:string,note:string>"


def facts_of(seed):
    r = random.Random(seed)
    mode = lambda: r.choice([None, None, ("p", "downgrade", "n"), ("p", "mitigate", "n")])
    rows = [(f"c{r.randint(0, 5)}", f"D{r.randint(0, 3)}", f"v{r.choice('aab')}", k, mode()) for k in range(150)]
    return rows + [("hot", "D1", f"v{r.randint(0, 3)}", 1000 + k, mode()) for k in range(150)] + [("low", "D1", "x", 2000, ("p", "downgrade", "n")), ("low", "D1", "y", 2001, ("p", "downgrade", "n"))]


def expected(spark, rows):
    facts = spark.createDataFrame(rows, FACTS)
    down = F.coalesce(F.col("benign.mode") == "downgrade", F.lit(False))
    settled = relational.consensus(facts, consensus.KEY, "normalizedValue", "entitySeq", down)
    benign = relational.benign_mode(facts, consensus.KEY, "normalizedValue", F.col("benign.mode"))
    values = facts.groupBy(*consensus.KEY).agg(F.count_distinct("normalizedValue").alias("values"), F.count("*").alias("facts"))
    out = settled.join(benign, consensus.KEY).join(values, consensus.KEY)
    drift = {r.conceptKey for r in relational.cross_drift(facts, "conceptKey", "documentId", "normalizedValue", "entitySeq", down).collect()}
    return {(r.conceptKey, r.documentId): (r.consensus, r["values"], r.facts, r.benign) for r in out.collect()}, drift


@pytest.mark.parametrize("batches", [1, 4])
def test_any_division(spark, tmp_path, batches):
    rows = facts_of(batches)
    r = random.Random(batches)
    late = rows[:]
    r.shuffle(late)  # facts come in any order
    cut = [late[k::batches] for k in range(batches)]
    said = {}
    for k, part in enumerate(cut):
        again = part + r.sample(late[: len(part)], 5) + (cut[0] if k == batches - 1 else [])  # some facts, and a whole batch, come once more
        spark.createDataFrame(again, FACTS).coalesce(2).write.mode("append").parquet(str(tmp_path / "facts"))
        stream = spark.readStream.schema(FACTS).parquet(str(tmp_path / "facts"))
        got = []
        consensus.keep_verdicts(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"), lambda df, n: got.extend(df.collect())).awaitTermination()
        said |= {x.conceptKey: x for x in got}
    store = consensus.latest(spark.read.option("basePath", str(tmp_path / "store")).parquet(str(tmp_path / "store")))
    keys, drift = expected(spark, rows)
    assert {(x.conceptKey, x.documentId): (x.consensus, x["values"], x.facts, x.benign) for x in store.collect()} == keys
    assert {c for c, x in said.items() if x.drifting} == drift and drift


def test_unchanged_keys_give_no_rows(spark, tmp_path):
    """Facts that were seen change nothing; new ones of one key change that key alone."""
    rows = facts_of(9)
    seen = []

    def add(part):
        spark.createDataFrame(part, FACTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "facts"))
        got = []
        stream = spark.readStream.schema(FACTS).parquet(str(tmp_path / "facts"))
        consensus.keep_verdicts(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint"), lambda df, n: got.extend(df.collect())).awaitTermination()
        seen.append({x.conceptKey for x in got})

    add(rows)
    add(rows[:50])
    add([("c1", "D9", "vb", 5000, None)])
    assert seen[0] == {r[0] for r in rows} and seen[1] == set() and seen[2] == {"c1"}
