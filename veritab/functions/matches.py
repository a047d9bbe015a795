"""All matches of a pattern in a text, with their groups and true offsets, as one array column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND = "array<struct<index:int,m:array<string>>>"


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body of a struct of values, each of them evaluated once a row however often body uses it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """array<struct<index int, m array<string>>>: m[0] is the match, m[k] group k ("" if it took no part).

    Offsets are the lengths of what stands between matches; a search for the matched strings
    would find earlier places where they stand unmatched. Empty matches are left out.
    """
    parts = {f"g{g}": F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in range(groups + 1)}

    def found(v: Column) -> Column:
        def hit(match: Column, k: Column) -> Column:
            gap = F.aggregate(F.slice(v["gaps"], 1, k + 1), F.lit(0), lambda a, x: a + F.length(x))
            before = F.aggregate(F.slice(v["g0"], 1, k), gap, lambda a, x: a + F.length(x))
            return F.struct(before.alias("index"), F.array(match, *[F.get(v[f"g{g}"], k) for g in range(1, groups + 1)]).alias("m"))

        return F.filter(F.transform(v["g0"], hit), lambda h: F.length(F.get(h["m"], F.lit(0))) > 0)

    return F.when(text.rlike(pattern), let({**parts, "gaps": F.split(text, pattern, -1)}, found)).otherwise(F.array().cast(FOUND))
