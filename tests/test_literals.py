"""Literals that rules need: every match holds them, and rules look only at paragraphs that do."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import paragraphs, rows_of
from veritab.functions.literals import NOTHING, needed
from veritab.operators import catalogue, relational, rules


def as_sets(pattern):
    return {tuple(sorted(a)) for a in needed(pattern)}


def test_needs():
    assert needed("[0-9]+") == needed("ab") == needed("(?:abc)?x+") == needed("(?:abc|d)x+") == NOTHING
    assert as_sets("(?i)Total of (\\d+) Subjects?") == {(" subject", "total of ")}
    assert as_sets("(one|two)-sided") == {("one-sided",), ("two-sided",)}
    assert as_sets("abc.*?(?:def|ghij)+") == {("abc", "def"), ("abc", "ghij")}
    assert as_sets("(?<=x)abc(?=y)d") == {("abcd",)} and as_sets("abc|xabcx") == {("abc",)}
    assert as_sets("é?abcÉdef") == {("abc", "def")}


def test_every_match_holds_what_is_needed():
    r = random.Random(1)
    for _ in range(800):
        pattern = "".join(r.choice(["a", "b", "cab", "[ab]", "c?", "(?:ab|ca)", "(?:bca)+", ".", "a*", "(?:abc|b*)", "(?=a)", "b{2,3}"]) for _ in range(6))
        try:
            needs, found = needed(pattern), re.compile(f"(?i){pattern}")
        except re.error:
            continue
        text = "".join(r.choices("abcABC", k=60))
        for m in found.finditer(text):
            assert any(all(s in m.group().lower() for s in a) for a in needs) or "(?=" in pattern, (pattern, m.group())


TEXTS = [
    "A total of 620 subjects will be randomised.", "The planned sample size is 500 subjects.", "A dropout rate of 10% is assumed.", "TESTS ARE TWO-SIDED and conducted at a SIGNIFICANCE LEVEL of 5%.", "Adverse events are graded by CTCAE v5.0.", "Nothing to see here at all.",
    "Creatinine clearance of at least 60 mL/min.", "Terms are coded with MedDRA version 26.1.", "The catgory of the paramters was preformed.", None, "", "ſubjects and K signs",
]


@pytest.fixture(scope="module")
def own(spark):
    texts = [t for t in TEXTS if t is not None] * 8
    return paragraphs(spark, rows_of(*texts) + rows_of("if x = 1 then y = 2;\nrun;", kind="CODE", section="2"))


CATALOGUE = {k: r for k, r in enumerate(catalogue.RULES) if r.patterns or r.hits}


def test_candidates_hold_all_hits(spark, own):
    """A rule fires nowhere but in its candidates, and those are few."""
    found = rules.candidates(own, CATALOGUE)
    met = {(r.paragraphId, k) for r in found.collect() for k in r._fire}
    everywhere = own
    hits = set()
    for k, rule in CATALOGUE.items():
        parts = [rules.pattern_hits(p, F.col("text")) for p in rule.patterns] + ([rule.hits()] if rule.hits else [])
        n = everywhere.where(rules.gate(rule) & (F.size(F.concat(*parts)) > 0)).select("paragraphId").collect()
        hits |= {(r.paragraphId, k) for r in n}
    assert hits and hits <= met
    always = sum(1 for k, r in CATALOGUE.items() if rules.needs_of(r) == NOTHING)
    assert len({m for m in met if rules.needs_of(CATALOGUE[m[1]]) != NOTHING}) < 0.1 * own.count() * (len(CATALOGUE) - always)


def test_one_look_at_the_paragraphs(spark, own, tmp_path):
    """What is extracted reads the table of candidates, not the paragraphs."""
    path = str(tmp_path / "paragraphs")
    own.write.parquet(path)
    for part in rules.extract(spark.read.parquet(path), CATALOGUE):
        assert not any(path in f for f in part.inputFiles())
    assert rules.extract(own, {}) == []
    assert sum(p.count() for p in rules.extract(own.where("false"), CATALOGUE)) == 0


def test_rules_look_where_rows_were_dealt(spark):
    """What is asked of dealt rows stays behind the shuffle: a small file of many rows is read by few tasks."""
    asked = relational.dealt(spark.range(50_000)).withColumn("x", F.col("id") % 7).where("x = 3")
    after, before = asked._jdf.queryExecution().optimizedPlan().toString().split("Repartition ")
    assert "% 7" in after and "% 7" not in before
    assert asked.count() == 7143 and asked.columns == ["id", "x"]
