"""Positioned items from the text operators of pages: a fold over each page that carries the graphics state.

A decoder splits a page's content into operators, a row each (OPERATORS); what they mean is decided
here. The state is the current matrix, the text state (font, size, leading, spacing, scale, rise), the
two text matrices, and a stack of what was saved. Pages are folded alone, in chunks of CHUNK operators,
so that time is linear in a page's operators.

Operators: q Q cm BT ET Tm Td TD T* Tf TL Tc Tw Tz Ts Tj ' " and TJ (a row for each element of its
array: a text, or a number in args). Td's numbers and the like are in args; Tf's font is in font; the
text that is shown is in text, with advance, the sum of its glyphs' widths in thousandths of the size.

Defined results. Other operators, those with too few or null numbers, texts that are null, and a Q
without its q do nothing. Blank texts move on and give no item. A null advance is 0. A font that
was never set has the family given as default. Rows with equal numbers come in the order of their
operator, text and numbers. Pages without operators, and an empty table, give no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = "documentId string, pdfPage int, opSeq long, op string, args array<double>, font string, text string, advance double"
CHUNK = 256
#: How many numbers each operator takes.
NUMBERS = {"q": 0, "Q": 0, "BT": 0, "ET": 0, "cm": 6, "Tm": 6, "Td": 2, "TD": 2, "T*": 0, "Tf": 1, "TL": 1, "Tc": 1, "Tw": 1, "Tz": 1, "Ts": 1, "Tj": 0, "'": 0, '"': 2, "TJ": 0}
MATRIX = ("a", "b", "c", "d", "e", "f")
UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: What q saves beside the matrix: name, value at a page's begin.
TEXT = {"font": None, "size": 0.0, "lead": 0.0, "chars": 0.0, "words": 0.0, "scale": 1.0, "rise": 0.0}


def simple(operators: DataFrame) -> DataFrame:
    """operators in which those that stand for several are these: TD, ' and "."""
    known = F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    args = F.coalesce("args", F.array().cast("array<double>"))
    own = operators.withColumn("args", args).where((F.size("args") >= F.try_element_at(known, F.col("op"))) & ~F.exists("args", lambda x: x.isNull()))
    one = lambda op, *numbers: F.struct(F.lit(op).alias("op"), F.array(*numbers).cast("array<double>").alias("args"))
    at = lambda i: F.get("args", F.lit(i))
    parts = (
        F.when(F.col("op") == "TD", F.array(one("TL", -at(1)), one("Td", at(0), at(1)))).when(F.col("op") == "'", F.array(one("T*"), one("Tj")))
        .when(F.col("op") == '"', F.array(one("Tw", at(0)), one("Tc", at(1)), one("T*"), one("Tj"))).otherwise(F.array(F.struct("op", "args")))
    )
    return own.select("documentId", "pdfPage", "opSeq", F.col("op").alias("_was"), F.posexplode(parts).alias("part", "_o"), "font", "text", F.coalesce("advance", F.lit(0.0)).alias("advance")).select("documentId", "pdfPage", "opSeq", "_was", "part", F.col("_o.op").alias("op"), F.col("_o.args").alias("args"), "font", "text", "advance")


def _struct(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _step(s: Column, x: Column) -> Column:
    """The state after one operator."""
    g, n = s["g"], lambda i: F.get(x["args"], F.lit(i))
    graphics = {k: g[k] for k in (*MATRIX, *TEXT)}
    line, text = {k: s["line"][k] for k in MATRIX}, {k: s["text"][k] for k in MATRIX}

    def state(g=None, line=None, text=None, stack=None, items=None) -> Column:
        return F.struct(
            (s["g"] if g is None else g).alias("g"), (s["line"] if line is None else line).alias("line"), (s["text"] if text is None else text).alias("text"),
            (s["stack"] if stack is None else stack).alias("stack"), (s["items"] if items is None else items).alias("items"))

    def times(m: dict[str, Column], k: dict[str, Column]) -> dict[str, Column]:
        row = lambda u, v, p: m[u] * k["a" if p == 0 else "b"] + m[v] * k["c" if p == 0 else "d"]
        return {"a": row("a", "b", 0), "b": row("a", "b", 1), "c": row("c", "d", 0), "d": row("c", "d", 1), "e": row("e", "f", 0) + k["e"], "f": row("e", "f", 1) + k["f"]}

    def moved(m: dict[str, Column], right: Column, up: Column) -> Column:
        return _struct({**m, "e": right * m["a"] + up * m["c"] + m["e"], "f": right * m["b"] + up * m["d"] + m["f"]})

    given = {k: n(i) for i, k in enumerate(MATRIX)}
    new = lambda **changed: state(g=_struct({**graphics, **changed}))
    both = lambda m: state(line=m, text=m)
    unit = _struct({k: F.lit(v) for k, v in zip(MATRIX, UNIT, strict=True)})
    size, scale, rise = g["size"], g["scale"], g["rise"]
    at = times(text, {k: g[k] for k in MATRIX})
    spaces = F.char_length(x["text"]) - F.char_length(F.replace(x["text"], F.lit(" "), F.lit("")))
    run = (x["advance"] / 1000 * size + F.char_length(x["text"]) * g["chars"] + spaces * g["words"]) * scale
    item = F.struct(
        x["text"].alias("text"), (rise * at["c"] + at["e"]).alias("x"), (rise * at["d"] + at["f"]).alias("y"), (F.abs(run) * F.hypot(at["a"], at["b"])).alias("width"), (F.abs(size) * F.hypot(at["c"], at["d"])).alias("height"),
        F.floor(F.degrees(F.atan2(size * scale * at["b"], size * scale * at["a"])) + 0.5).cast("int").alias("rotation"), g["font"].alias("font"))
    shown = state(text=moved(text, run, F.lit(0.0)), items=F.when(F.trim(x["text"]) == "", s["items"]).otherwise(F.concat(s["items"], F.array(item))))
    saved = F.size(s["stack"])
    op = x["op"]
    return (
        F.when(op.isin("Tj", "TJ") & x["text"].isNotNull(), shown)
        .when((op == "TJ") & (F.size(x["args"]) > 0), state(text=moved(text, -n(0) / 1000 * size * scale, F.lit(0.0))))
        .when(op == "Td", both(moved(line, n(0), n(1)))).when(op == "T*", both(moved(line, F.lit(0.0), -g["lead"]))).when(op == "Tm", both(_struct(given))).when(op == "BT", both(unit))
        .when(op == "Tf", new(font=F.coalesce(x["font"], g["font"]), size=n(0))).when(op == "TL", new(lead=n(0))).when(op == "Tc", new(chars=n(0))).when(op == "Tw", new(words=n(0))).when(op == "Tz", new(scale=n(0) / 100)).when(op == "Ts", new(rise=n(0)))
        .when(op == "cm", new(**times(given, {k: g[k] for k in MATRIX})))
        .when(op == "q", state(stack=F.concat(s["stack"], F.array(s["g"])))).when((op == "Q") & (saved > 0), state(g=F.element_at(s["stack"], -1), stack=F.slice(s["stack"], F.lit(1), saved - 1)))
        .otherwise(s)
    )


def items_of(operators: DataFrame, families: DataFrame | None = None, default: str = "sans-serif") -> DataFrame:
    """The items of pages of operators, numbered as they are shown. families: (documentId, font, fontFamily), a row a font."""
    fields = ("opSeq", "part", "_was", "op", "args", "font", "text", "advance")
    pages = simple(operators).groupBy("documentId", "pdfPage").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ops"))  # a page's operators
    chunks = F.transform(F.sequence(F.lit(1), F.size("ops"), F.lit(CHUNK)), lambda i: F.slice("ops", i, CHUNK))
    numbers = lambda values: ", ".join(f"{v}D AS {k}" for k, v in values)
    unit = f"struct({numbers(zip(MATRIX, UNIT, strict=True))})"
    graphics = F.expr(f"struct({numbers(zip(MATRIX, UNIT, strict=True))}, CAST(NULL AS string) AS font, {numbers((k, v) for k, v in TEXT.items() if v is not None)})")
    shape = "array<struct<text:string,x:double,y:double,width:double,height:double,rotation:int,font:string>>"
    none = F.array().cast(shape)
    start = F.struct(graphics.alias("g"), F.expr(unit).alias("line"), F.expr(unit).alias("text"), F.slice(F.array(graphics), 1, 0).alias("stack"), none.alias("items"))
    total = F.struct(start.alias("s"), F.array().cast(f"array<{shape}>").alias("done"))

    def chunk(t: Column, ops: Column) -> Column:
        # One look at the chunk: its state is an array of one, so that it is computed once.
        after = F.array(F.aggregate(ops, t["s"], _step))
        return F.get(F.transform(after, lambda s: F.struct(s.withField("items", none).alias("s"), F.concat(t["done"], F.array(s["items"])).alias("done"))), F.lit(0))

    shown = pages.select("documentId", "pdfPage", F.posexplode(F.aggregate(chunks, total, chunk, lambda t: F.flatten(t["done"]))).alias("itemSeq", "i")).select("documentId", "pdfPage", "itemSeq", "i.*")
    if families is None:
        named = shown.withColumn("fontFamily", F.lit(default))
    else:
        named = shown.join(families.select("documentId", "font", "fontFamily"), ["documentId", "font"], "left").withColumn("fontFamily", F.coalesce("fontFamily", F.lit(default)))
    return named.select("documentId", "pdfPage", "itemSeq", "text", "x", "y", "width", "height", "rotation", "fontFamily")
