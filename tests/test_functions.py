import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions.matches import matches

CASES = [
    ("to_number", S.to_number, ["1,240", "twenty-one", "forty two", "nineteen", "3.50", "many"], [1240.0, 21.0, 42.0, 19.0, 3.5, None]),
    ("number_text", lambda c: S.number_text(c.cast("double")), ["16.0", "0.00001", "2.5", "-3"], ["16", "0.00001", "2.5", "-3"]),
    ("unit", S.unit, ["Days", "mg/KG", "per cent", "furlong."], ["days", "mg/kg", "%", "furlong"]),
    ("comparator", S.comparator, ["≥", "at least", "below", "near"], ["GTE", "GTE", "LT", "NEAR"]),
    ("frequency", S.frequency, ["once daily", "b.i.d.", "every 21 days", "every 3 weeks", "now and then"], ["QD", "BID", "Q21D", "Q3W", "NOW AND THEN"]),
    ("timepoint", S.timepoint, ["Cycle 2 Day 15", "the end-of-treatment visit", "Week 9"], ["c2d15", "eot", "week_9"]),
    ("timepoint_label", S.timepoint_label, ["c2d15", "eot", "week_9"], ["Cycle 2 Day 15", "end of treatment", "week 9"]),
    ("grade_range", S.grade_range, ["ECOG of 0 or 1", "AB-12 grade 2", "v1.0 at 55%"], ["0-1", "2", None]),
    ("stem", S.stem, ["histological", "studies", "sensitivity", "as"], ["histolog", "stud", "sensit", "as"]),
    ("identifier_root", S.identifier_root, ["trtgrpn", "aval_2", "aei"], ["trtgr", "vl", "aei"]),
    ("tidy", S.tidy, [" a   b.,", "x;"], ["a b", "x"]),
    ("decimals", S.decimals_of, ["0.290", "7"], [3, 0]),
    ("half_up", lambda c: S.half_up(c.cast("double")), ["1.005", "-2.125", "0.125"], [1.0, -2.12, 0.13]),
    ("shorten", lambda c: S.shorten(c, 5), ["abcdef", "abc"], ["abcd…", "abc"]),
]


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_scalar(spark, case):
    _, f, given_, expected = case
    rows = spark.createDataFrame(list(enumerate(given_)), "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    assert [r.y for r in rows] == expected


def test_arrays(spark):
    row = spark.range(1).select(
        S.content_tokens(F.lit("The handling of partial dates")).alias("t"), S.tokens_contained(F.array(F.lit("dat")), F.array(F.lit("date"))).alias("c"), S.overlap(F.array(F.lit("a"), F.lit("zz")), F.array(F.lit("abc"))).alias("o"),
        S.only_case_or_punctuation(F.array(F.lit("Full-Set"), F.lit("full set"))).alias("p"), S.listed(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("l"), S.snippet(F.lit("x " * 200 + "hit" + " y" * 200), F.lit(400), F.lit(3), 10).alias("s"), S.excerpt(F.lit("abc"), F.lit("b")).alias("e")).first()
    assert row.t == ["handl", "parti", "date"] and row.c and row.o == 1 and row.p and row.l == "a, b and c" and row.s == "… x x x x hit y y y y …" and tuple(row.e) == ("a", "b", "c")


def test_offsets_are_those_of_matches(spark):
    row = spark.range(1).select(matches(F.lit("abcab ab x ab"), r"(?<![a-z])ab(?![a-z])").alias("m")).first()
    assert [m["index"] for m in row.m] == [6, 11]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ab1 -", max_size=12), min_size=1, max_size=8))
def test_matches_like_re(spark, texts):
    import re

    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", matches(F.col("x"), "([ab]+)1?", 1).alias("m")).orderBy("i").collect()
    assert [[(m["index"], list(m.m)) for m in r.m] for r in got] == [[(m.start(), [m[0], m[1]]) for m in re.finditer("([ab]+)1?", t)] for t in texts]
