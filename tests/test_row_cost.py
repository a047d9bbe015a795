"""Work that costs by the row: tables of few bytes are dealt over tasks, and what a row needs often is worked out once."""

from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.operators import relational


def test_few_bytes_are_dealt_by_rows(spark):
    rows = spark.range(25_000).coalesce(1)
    assert relational.dealt(rows).rdd.getNumPartitions() == 3
    assert relational.dealt(rows.limit(0)).count() == 0


def test_a_token_is_cleaned_once(spark):
    """The plan of a token's stem names its cleaning once, not once for every suffix."""
    df = spark.createDataFrame([("Handlings",), ("of-ing",), ("mechanically",), ("",), (None,)], "t string")
    plan = df.select(S.stem(F.col("t")).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") == 1
    phrase = df.select(S.content_tokens(F.col("t")).alias("w"))
    assert phrase._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 0
    assert [r.w for r in phrase.collect()][0] == [r.s for r in df.select(S.stem(F.col("t")).alias("s")).collect()][:1]
