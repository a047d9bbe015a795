"""Prefix matching by intervals against all comparisons; tokens of a million letters."""

import random

from pyspark.sql import functions as F

from veritab.operators import relational
from veritab.operators.prefixes import BIN, intervals, prefix_pairs


def table(spark, words):
    return spark.createDataFrame([(w,) for w in words], "x string").repartition(3)


def brute(left, right):
    return {(a, b) for a in left for b in right if a and b and (a.startswith(b) or b.startswith(a))}


def pairs(spark, left, right):
    got = [tuple(r) for r in prefix_pairs(table(spark, left), table(spark, right)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_pairs(spark):
    r = random.Random(2)
    words = {"".join(r.choices("abé𝛑", k=r.randint(1, 7))) for _ in range(700)} | {"a", "b", "a\x7f", "a\U0010ffff", "a￿"}
    left, right = r.sample(sorted(words), 300), r.sample(sorted(words), 400)
    assert len(left) > BIN
    assert pairs(spark, [*left, None, "", left[0]], [*right, None, ""]) == brute(left, right)
    assert pairs(spark, [], right) == set() and pairs(spark, left, []) == set()


def test_intervals(spark):
    words = ["a", "ab", "abc", "b", "abd", "ac", "é", "éa"]
    got = {r.x: (r.low, r.high) for r in intervals(table(spark, words)).collect()}
    for a in words:
        assert {b for b in words if got[a][0] <= got[b][0] < got[a][1]} == {b for b in words if b.startswith(a)}


def test_a_token_of_a_million_letters(spark):
    long = "ab" * 500_000
    left, right = [long, "ab", "b", long + "c"], [long[:-1], "aba", long, "x", "abab" * 100]
    assert pairs(spark, left, right) == brute(left, right)
    nodes = spark.createDataFrame([(1, [long, "x"]), (2, [long[:-3], "x"]), (3, ["b", "y"]), (4, [long + "q", "z"])], "n long, t array<string>")
    assert {tuple(r) for r in relational.similar_pairs(nodes, "n", "t", 0.6).collect()} == {(1, 2)}


def similar_brute(rows, least):
    out = set()
    for i, (a, s) in enumerate(rows):
        for b, t in rows[i + 1 :]:
            if s and t:
                shared = sum(any(x.startswith(y) or y.startswith(x) for y in t) for x in s)
                if shared / len(set(s) | set(t)) >= least:
                    out.add((a, b))
    return out


def groups(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {frozenset(y for y in root if find(y) == find(x)) for x in root}


def test_similar_pairs_with_a_hot_token(spark, monkeypatch):
    """A token of most nodes is dealt over salts; links have the groups of all comparisons."""
    monkeypatch.setattr(relational, "HOT_ROWS", 8)
    r = random.Random(3)
    rows = [(i, ["form"] * (r.random() < 0.7) + ["".join(r.choices("ab", k=r.randint(1, 5))) for _ in range(r.randint(0, 3))]) for i in range(60)]
    got = relational.similar_pairs(spark.createDataFrame(rows, "n long, t array<string>"), "n", "t", 0.6)
    expected = similar_brute(rows, 0.6)
    edges = {tuple(e) for e in got.collect()}
    assert groups(edges) == groups(expected) and len(groups(edges)) > 0


def test_most_shared_with_a_hot_token(spark, monkeypatch):
    monkeypatch.setattr(relational, "HOT_ROWS", 8)
    r = random.Random(4)
    word = lambda: "".join(r.choices("abc", k=r.randint(1, 4)))
    subjects = {(s, word()): r.randint(1, 3) for s in range(8) for _ in range(6)}
    others = {(o, w) for o in range(40) for w in (word(), word(), "a")}
    got = relational.most_shared(spark.createDataFrame([(s, w, n) for (s, w), n in subjects.items()], "s long, w string, n long"), "s", "w", "n", spark.createDataFrame(sorted(others), "o long, x string"), "o", "x")
    expected = {}
    for s in {s for s, _ in subjects}:
        sums = {o: sum(n for (q, w), n in subjects.items() if q == s and any(o == p and (w.startswith(x) or x.startswith(w)) for p, x in others)) for o in range(40)}
        best = min(sums, key=lambda o: (-sums[o], o))
        if sums[best]:
            expected[s] = (best, sums[best])
    assert {r.s: (r.o, r.shared) for r in got.collect()} == expected


def test_no_prefix_is_exploded(spark):
    plan = prefix_pairs(table(spark, ["a"]), table(spark, ["ab"])).select(F.col("l"))._jdf.queryExecution().toString()
    assert "left(" not in plan and "substring" not in plan.lower()
