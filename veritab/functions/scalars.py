"""Scalar functions over columns: numbers in words, units, versions, tokens, rounding. No Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritab.functions.matches import let
from veritab.model import chosen

#: White space as the extraction patterns mean it: with the no-break space.
WS = r"[\s ]"
#: A word boundary that knows ASCII letters, digits and _ only.
WB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: Numbers in words.
SMALL_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen",
    "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
#: Spellings of units.
UNITS = [
    (r"(?i)^(mg|milligram|milligrams)$", "mg"),
    (r"(?i)^(mg/kg)$", "mg/kg"),
    (r"(?i)^(mg/m2|mg/m\^2)$", "mg/m2"),
    (r"(?i)^(ml/min|millilitres per minute|milliliters per minute)$", "mL/min"),
    (r"(?i)^(day|days|d)$", "days"),
    (r"(?i)^(week|weeks|wk|wks)$", "weeks"),
    (r"(?i)^(cycle|cycles)$", "cycles"),
    (r"(?i)^(month|months|mo)$", "months"),
    (r"(?i)^(year|years|yr|yrs)$", "years"),
    (r"(?i)^(%|percent|per cent|percentage points)$", "%"),
]
#: Spellings of comparators.
COMPARATORS = [
    (r"(?i)^(≥|>=|greater than or equal to|at least|of at least|no less than)$", "GTE"),
    (r"(?i)^(≤|<=|less than or equal to|at most|no more than|not exceeding)$", "LTE"),
    (r"(?i)^(>|greater than|above|exceeding)$", "GT"),
    (r"(?i)^(<|less than|below|under)$", "LT"),
    (r"(?i)^(=|equal to|of)$", "EQ"),
]
#: Spellings of frequencies.
FREQUENCIES = [
    (r"(?i)^(once daily|once a day|daily|q\.?d\.?|od)$", "QD"),
    (r"(?i)^(twice daily|twice a day|two times daily|b\.?i\.?d\.?)$", "BID"),
    (r"(?i)^(three times daily|t\.?i\.?d\.?)$", "TID"),
    (r"(?i)^(once weekly|weekly|q\.?w\.?)$", "QW"),
]
#: Words without content, and suffixes in the order they are tried.
STOP_WORDS = [
    "the", "a", "an", "of", "and", "or", "for", "to", "in", "on", "at", "by", "this", "that", "these", "those", "page", "ecrf", "crf", "data",
    "form",
]
SUFFIXES = ("ically", "ical", "ivity", "ity", "ive", "ies", "ing", "ed", "al", "ic", "s")


def tidy(c: Column) -> Column:
    """White space as single blanks, no trailing punctuation, no blanks at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, WS + "+", " "), "[.,;:]+$", ""))


def to_number(c: Column) -> Column:
    """A number in digits (with commas) or in English words below one hundred; else null."""
    small = F.create_map(*[F.lit(x) for i, w in enumerate(SMALL_WORDS) for x in (w, float(i))])
    tens = F.create_map(*[F.lit(x) for w, n in TENS.items() for x in (w, float(n))])

    def read(v: Column) -> Column:
        t, parts = v["t"], F.split(v["t"], "[- ]", -1)
        pair = F.when(F.size(parts) == 2, F.try_element_at(tens, F.get(parts, F.lit(0))) + F.try_element_at(small, F.get(parts, F.lit(1))))
        return F.coalesce(F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double")), F.try_element_at(small, t), F.try_element_at(tens, t), pair)

    return let({"t": F.regexp_replace(F.lower(F.trim(c)), ",", "")}, read)


def number_text(x: Column) -> Column:
    """The shortest usual text of a double: integers without a point, no exponent for small ones."""

    def shown(v: Column) -> Column:
        x = v["x"]
        plain = F.regexp_replace(F.format_string("%.12f", x), r"0+$", "")
        return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")).when(F.abs(x) < 1e-3, plain).otherwise(x.cast("string"))

    return let({"x": x}, shown)


def number_or(c: Column) -> Column:
    """The text of the number that c states, or c itself."""
    return F.coalesce(number_text(to_number(c)), c)


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounded half towards plus infinity on the binary value."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fixed(x: Column, digits: int) -> Column:
    """x with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", half_up(x, digits))


def decimals_of(c: Column) -> Column:
    """How many digits stand behind the point of a number's text."""
    return F.length(F.regexp_extract(c, r"\.(\d+)", 1))


def unit(c: Column) -> Column:
    return chosen(tidy(c), UNITS, tidy(c))


def comparator(c: Column) -> Column:
    return chosen(tidy(c), COMPARATORS, F.upper(tidy(c)))


def threshold(sign: Column, value: Column, of_unit: Column) -> Column:
    return F.concat_ws(" ", comparator(sign), number_or(value), unit(of_unit))


def frequency(c: Column) -> Column:
    t = tidy(c)
    every = F.concat(F.lit("Q"), F.regexp_extract(t, r"(?i)^every (\d+)", 1), F.upper(F.regexp_extract(t, r"(?i)^every \d+ ([dw])", 1)))
    return chosen(t, FREQUENCIES, F.when(t.rlike(r"(?i)^every \d+ (days|weeks)$"), every).otherwise(F.upper(t)))


def scale_version(scale: str, version: Column) -> Column:
    """Versions stay text: 4.0 is not 4."""
    return F.concat_ws(" ", F.lit(scale), F.trim(version))


def sidedness(c: Column) -> Column:
    t = F.lower(tidy(c))
    return F.when(t.startswith("one"), "ONE-SIDED").when(t.startswith("two"), "TWO-SIDED").otherwise("UNSPECIFIED")


def alpha(value: Column, sides: Column, percent: bool = False) -> Column:
    n = to_number(value)
    shown = F.coalesce(number_text(n / 100 if percent else n), value)
    return F.concat(F.lit("alpha "), shown, F.lit(" ("), F.lower(sidedness(sides)), F.lit(")"))


def ci_level(level: Column, sides: Column) -> Column:
    return F.concat(number_or(level), F.lit("% CI ("), F.lower(sidedness(sides)), F.lit(")"))


def interval(low: Column, high: Column) -> Column:
    return F.concat(F.lit("["), number_or(low), F.lit(", "), number_or(high), F.lit("]"))


def grade_range(c: Column, most: int = 5) -> Column:
    """Least and greatest isolated digit up to most, field codes left out; null if there is none."""
    digits = F.filter(F.regexp_extract_all(F.regexp_replace(c, WB + r"[A-Z]{2,6}-\d+" + WB, " "), F.lit(r"(?<![A-Za-z0-9_.])\d(?![A-Za-z0-9_.%])"), F.lit(0)), lambda d: d <= str(most))
    low, high = F.array_min(digits), F.array_max(digits)
    return F.when(F.size(digits) > 0, F.when(low == high, low).otherwise(F.concat(low, F.lit("-"), high)))


def timepoint(c: Column) -> Column:
    t = F.lower(tidy(c))
    at = r"cycle\s*(\d+)\s*day\s*(\d+)"
    named = [(r"end[- ]of[- ]treatment", "eot"), (r"end[- ]of[- ]study", "eos"), ("screening", "screening"), ("baseline", "baseline"), ("surgery", "surgery")]
    slug = F.regexp_replace(t, "[^a-z0-9]+", "_")
    return F.when(t.rlike(at), F.concat(F.lit("c"), F.regexp_extract(t, at, 1), F.lit("d"), F.regexp_extract(t, at, 2))).otherwise(chosen(t, named, slug))


def timepoint_label(c: Column) -> Column:
    at = r"^c(\d+)d(\d+)$"
    cycle = F.concat(F.lit("Cycle "), F.regexp_extract(c, at, 1), F.lit(" Day "), F.regexp_extract(c, at, 2))
    return F.when(c.rlike(at), cycle).when(c == "eot", "end of treatment").when(c == "eos", "end of study").otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def tolerance(value: Column, of_unit: Column) -> Column:
    return F.concat(F.lit("+/-"), number_or(value), F.lit(" "), unit(of_unit))


def term(c: Column) -> Column:
    return F.lower(tidy(c))


def stem(token: Column) -> Column:
    return let({"t": F.regexp_replace(F.lower(token), "[^a-z0-9]", "")}, lambda v: _bare(v["t"]))


def _bare(t: Column) -> Column:
    """A token of a-z0-9 without its suffix; t is named often, so it has to be a variable."""
    out = t
    for s in reversed(SUFFIXES):
        out = F.when((F.length(t) > len(s) + 2) & t.endswith(s), F.left(t, F.length(t) - len(s))).otherwise(out)
    return out


def content_tokens(phrase: Column) -> Column:
    """Stems of the words that carry content, in order."""
    words = F.filter(F.split(F.lower(phrase), "[^a-z0-9]+"), lambda t: (F.length(t) > 0) & ~t.isin(STOP_WORDS))
    return F.transform(words, _bare)


def _prefixed(a: Column, b: Column) -> Column:
    return a.startswith(b) | b.startswith(a)


def tokens_contained(inner: Column, outer: Column) -> Column:
    return (F.size(inner) > 0) & F.forall(inner, lambda t: F.exists(outer, lambda o: _prefixed(t, o)))


def overlap(subject: Column, other: Column) -> Column:
    """How many tokens of subject are a prefix of a token of other, or the other way."""
    return F.size(F.filter(subject, lambda t: F.exists(other, lambda o: _prefixed(t, o))))


def identifier_root(c: Column) -> Column:
    base = F.regexp_replace(F.regexp_replace(F.lower(c), "[0-9_]", ""), "(p?n)$", "")
    bare = F.translate(base, "aeiou", "")
    return F.when(F.length(bare) >= 2, bare).otherwise(base)


def only_case_or_punctuation(values: Column) -> Column:
    """Whether all values are one once lower-cased and stripped to letters and digits."""
    return F.size(F.array_distinct(F.transform(values, lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9]", "")))) == 1


def shorten(c: Column, most: int = 90) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - 1)), F.lit("…"))).otherwise(c)


def listed(names: Column) -> Column:
    """a, b and c"""
    n = F.size(names)
    return F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.get(names, n - 1)))


def snippet(text: Column, index: Column, length: Column, reach: int = 120) -> Column:
    """The text around a match, cut at word ends, with marks where it was cut; index counts from 0."""
    n = F.length(text)
    low, high = F.greatest(index - reach, F.lit(0)), F.least(index + length + reach, n)
    body = F.substr(text, low + 1, high - low)
    left = F.when(low > 0, F.concat(F.lit("… "), F.regexp_replace(body, r"^\S*\s+", ""))).otherwise(body)
    both = F.when(high < n, F.concat(F.regexp_replace(left, r"\s+\S*\z", ""), F.lit(" …"))).otherwise(left)
    return F.trim(F.regexp_replace(both, WS + "+", " "))


def citation_label(doc_type: Column, version: Column, section: Column, printed: Column, pdf: Column) -> Column:
    page = F.when(printed.isNull(), F.concat(F.lit("front matter, PDF p. "), pdf.cast("string"))).otherwise(F.concat(F.lit("p. "), printed.cast("string"), F.lit(" (PDF p. "), pdf.cast("string"), F.lit(")")))
    return F.concat(doc_type, F.lit(" "), version, F.lit(" §"), section, F.lit(", "), page)


def excerpt(text: Column, value: Column) -> Column:
    """before, match and after of the first place of value in text; all before if it is absent."""
    at = F.instr(text, value)
    return F.when(at > 0, F.struct(F.substr(text, F.lit(1), at - 1).alias("before"), value.alias("match"), F.substr(text, at + F.length(value)).alias("after"))).otherwise(F.struct(text.alias("before"), F.lit("").alias("match"), F.lit("").alias("after")))


def shade(count: Column) -> Column:
    return F.least(F.lit(0.16), 0.05 + 0.025 * count)
