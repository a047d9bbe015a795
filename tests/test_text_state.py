"""The fold over text operators against a plain interpreter with matrices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.sources import text_state
from veritab.sources.text_state import OPERATORS, items_of


def matrix(a, b, c, d, e, f):
    return np.array([[a, b, 0], [c, d, 0], [e, f, 1]], float)


def plain(ops):
    """Items of one page."""
    start = {"m": np.eye(3), "font": None, "size": 0.0, "lead": 0.0, "chars": 0.0, "words": 0.0, "scale": 1.0, "rise": 0.0}
    g, stack, line, text, out = dict(start), [], np.eye(3), np.eye(3), []

    def show(t, advance):
        nonlocal text
        if t is None:
            return
        at = matrix(g["size"] * g["scale"], 0, 0, g["size"], 0, g["rise"]) @ text @ g["m"]
        run = (advance / 1000 * g["size"] + len(t) * g["chars"] + t.count(" ") * g["words"]) * g["scale"]
        if t.strip(" "):
            both = text @ g["m"]
            out.append((t, at[2, 0], at[2, 1], abs(run) * math.hypot(both[0, 0], both[0, 1]), math.hypot(at[1, 0], at[1, 1]), math.floor(math.degrees(math.atan2(at[0, 1], at[0, 0])) + 0.5), g["font"]))
        text = matrix(1, 0, 0, 1, run, 0) @ text

    def move(x, y):
        nonlocal line, text
        line = matrix(1, 0, 0, 1, x, y) @ line
        text = line

    for op, args, font, t, advance in ops:
        advance = advance or 0.0
        if op == "q":
            stack.append(dict(g))
        elif op == "Q":
            g = stack.pop() if stack else g
        elif op == "cm":
            g["m"] = matrix(*args) @ g["m"]
        elif op == "BT":
            line = text = np.eye(3)
        elif op == "Tm":
            line = text = matrix(*args)
        elif op == "Td":
            move(*args)
        elif op == "TD":
            g["lead"] = -args[1]
            move(*args)
        elif op == "T*":
            move(0, -g["lead"])
        elif op == "Tf":
            g["font"], g["size"] = font or g["font"], args[0]
        elif op in ("TL", "Tc", "Tw", "Ts"):
            g[{"TL": "lead", "Tc": "chars", "Tw": "words", "Ts": "rise"}[op]] = args[0]
        elif op == "Tz":
            g["scale"] = args[0] / 100
        elif op == "Tj":
            show(t, advance)
        elif op == "'":
            move(0, -g["lead"])
            show(t, advance)
        elif op == '"':
            g["words"], g["chars"] = args
            move(0, -g["lead"])
            show(t, advance)
        elif op == "TJ" and t is not None:
            show(t, advance)
        elif op == "TJ" and args:
            text = matrix(1, 0, 0, 1, -args[0] / 1000 * g["size"] * g["scale"], 0) @ text
    return out


def stream(rng, n):
    number = lambda: rng.choice([0.0, 1.0, 2.5, -3.0, 12.0, 0.25])
    out = [("Tf", [9.5], "F0", None, None)]
    for _ in range(n):
        op = rng.choice([*text_state.NUMBERS, "Tj", "Tj", "TJ", "Td", "re", "ET", "q", "Q"])
        args = [number() for _ in range(text_state.NUMBERS.get(op, 0))]
        if op in ("cm", "Tm"):
            turn = math.radians(rng.choice([0, 0, 90, -90, 38, 180]))
            args = [math.cos(turn), math.sin(turn), -math.sin(turn), math.cos(turn), number(), number()]
        if op == "Tf":
            args = [rng.choice([8.0, 10.0, 7.5])]
        if op == "Tz":
            args = [rng.choice([50.0, 100.0])]
        text = rng.choice(["a", "two words", " ", "é𝒳", "", None]) if op in ("Tj", "'", '"', "TJ") else None
        if op == "TJ" and text is None:
            args = [120.0]
        out.append((op, args, rng.choice(["F1", "F2", None]) if op == "Tf" else None, text, rng.choice([500.0, 1234.0, None]) if text else None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_like_an_interpreter(spark, seed):
    rng = random.Random(seed)
    pages = {(d, p): stream(rng, rng.choice([0, 1, 30, 255, 256, 900])) for d in "AB" for p in range(1, 5)}
    rows = [(d, p, k, *op) for (d, p), ops in pages.items() for k, op in enumerate(ops)]
    got = {}
    for r in items_of(spark.createDataFrame(rows, OPERATORS).repartition(6), spark.createDataFrame([("A", "F1", "Courier"), ("B", "F1", "Times")], "documentId string, font string, fontFamily string")).orderBy("documentId", "pdfPage", "itemSeq").collect():
        got.setdefault((r.documentId, r.pdfPage), []).append(r)
    for page, ops in pages.items():
        expected, own = plain(ops), got.get(page, [])
        assert [(r.itemSeq, r.text) for r in own] == [(i, x[0]) for i, x in enumerate(expected)]
        for r, x in zip(own, expected, strict=True):
            assert (r.x, r.y, r.width, r.height) == pytest.approx(x[1:5], abs=1e-6)
            assert (r.rotation - x[5]) % 360 in (0, 1, 359) and r.fontFamily == {"F1": {"A": "Courier", "B": "Times"}[page[0]]}.get(x[6], "sans-serif")


def test_saved_states_and_odd_rows(spark):
    rows = [
        ("D", 1, 0, "q", None, None, None, None), ("D", 1, 1, "cm", [2.0, 0.0, 0.0, 2.0, 10.0, 20.0], None, None, None), ("D", 1, 2, "Tf", [10.0], "F1", None, None), ("D", 1, 3, "BT", None, None, None, None), ("D", 1, 4, "Td", [5.0, 6.0], None, None, None),
        ("D", 1, 5, "Tj", None, None, "in", 1000.0), ("D", 1, 6, "Q", None, None, None, None), ("D", 1, 7, "Q", None, None, None, None), ("D", 1, 8, "Tf", [4.0], None, None, None), ("D", 1, 9, "Tj", None, None, "out", None),
        ("D", 1, 10, "Td", [1.0], None, None, None), ("D", 1, 11, "Td", [1.0, None], None, None, None), ("D", 1, 12, None, None, None, "x", None), ("D", 2, 0, "Tj", None, None, None, None)]
    got = [tuple(r) for r in items_of(spark.createDataFrame(rows, OPERATORS)).collect()]
    assert got == [("D", 1, 0, "in", 20.0, 32.0, 20.0, 20.0, 0, "sans-serif"), ("D", 1, 1, "out", 15.0, 6.0, 0.0, 4.0, 0, "sans-serif")]
    assert items_of(spark.createDataFrame([], OPERATORS)).count() == 0


def test_a_page_of_many_operators(spark):
    """50,000 operators on a page, in time linear in them."""
    one = spark.range(25_000).select(F.explode(F.array(F.struct((F.col("id") * 2 + 1).alias("opSeq"), F.lit("Td").alias("op"), F.array(F.lit(1.0), F.lit(-2.0)).alias("args"), F.lit(None).cast("string").alias("text")), F.struct((F.col("id") * 2 + 2).alias("opSeq"), F.lit("Tj").alias("op"), F.array().cast("array<double>").alias("args"), F.lit("t").alias("text")))).alias("o"))
    rows = one.select(F.lit("D").alias("documentId"), F.lit(1).alias("pdfPage"), "o.opSeq", "o.op", "o.args", F.lit(None).cast("string").alias("font"), "o.text", F.lit(0.0).alias("advance"))
    assert items_of(rows).where("x = itemSeq + 1 AND y = -2 * (itemSeq + 1)").count() == 25_000
