"""The best section for a description, searched from rare tokens on, against all sections."""

import random

from pyspark.sql import functions as F

from tests.helpers import paragraphs, rows_of
from veritab.operators import contextual, relational
from veritab.operators.top_overlap import best_by_overlap

HELD, ASKS = "key string, seq long, tokens array<string>", "key string, subject array<string>"


def brute(asks, held):
    out = {}
    for key, subject in asks:
        scores = {q: sum(any(x.startswith(y) or y.startswith(x) for y in tokens) for x in subject) for k, q, tokens in held if k == key and tokens}
        best = min(scores, key=lambda q: (-scores[q], q), default=None)
        if best is not None and scores[best]:
            out[key, tuple(subject)] = (best, scores[best])
    return out


def found(spark, asks, held):
    rows = best_by_overlap(spark.createDataFrame(asks, ASKS).repartition(3), spark.createDataFrame(held, HELD).repartition(3)).collect()
    got = {(r.key, tuple(r.subject)): (r.seq, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def test_best(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 4)))
    held = [(f"D{r.randint(0, 2)}", q, [word() for _ in range(r.randint(0, 4))] + ["table"] * (r.random() < 0.6)) for q in range(120)]
    asks = [(f"D{r.randint(0, 3)}", [word() for _ in range(r.randint(0, 4))] + ["tables"] * (r.random() < 0.5)) for _ in range(80)]
    assert found(spark, [*asks, asks[0], ("D0", ["zzz"]), ("D1", ["table", "table", "tab"])], held) == brute([*asks, ("D0", ["zzz"]), ("D1", ["table", "table", "tab"])], held)


def test_nothing_to_find(spark):
    assert found(spark, [], [("D", 1, ["a"])]) == {} == found(spark, [("D", ["a"])], [])


def test_a_document_of_100_000_sections(spark, monkeypatch):
    """Every section holds the same frequent token; what rarer tokens settle does not read its list."""
    held = spark.range(100_000).select(F.lit("D").alias("key"), F.col("id").alias("seq"), F.array(F.lit("table"), F.concat(F.lit("w"), F.lpad((F.col("id") % 50_000).cast("string"), 5, "0"))).alias("tokens"))
    asks = [("D", [f"w{i:05d}", "table"]) for i in range(0, 50_000, 500)] + [("D", ["tables"]), ("D", ["no", "table"])]
    read = []
    whole = relational.met_by
    monkeypatch.setattr(relational, "met_by", lambda l, r, k: read.append(l.count()) or whole(l, r, k))
    got = {(r.key, tuple(r.subject)): (r.seq, r.score) for r in best_by_overlap(spark.createDataFrame(asks, ASKS), held).collect()}
    assert got == {("D", tuple(s)): (int(s[0][1:]), 2) if len(s) == 2 and s[0] != "no" else (0, 1) for _, s in asks}
    assert read == [100]  # one round over lists: of the rare tokens alone


def test_references_by_description(spark):
    p = paragraphs(spark, rows_of("See Section 2 for details of the statistical methods. As described in Section 9, the endpoints (Section 1) hold."))
    sections = spark.createDataFrame([("D1", q, i, h) for q, i, h in [(0, "FRONT MATTER", "FRONT MATTER"), (1, "1", "Study endpoints"), (2, "2", "Statistical methods"), (3, "2#3", "Statistical methods")]], "documentId string, sectionSeq long, id string, heading string")
    values = {r.hit.normalizedValue for r in contextual.references(p, sections).collect()}
    assert "RESOLVED" in values and any(v.startswith("UNRESOLVED") for v in values)
