"""Secret scans over a trigram inverted index, in DataFrame operations alone.

A rule is a regex of a kind of secret. From each regex a Boolean query over trigrams is derived: any of
some alternatives, each of them trigrams that every match holds. The index has a posting (trigram,
text) for the trigrams that the rules' queries name, in lower case, so that one index serves rules of
either case. Postings are met with the alternatives and counted: a text that has all trigrams of an
alternative is a candidate of its rule. Candidates are verified by the regex itself, from left to right
without overlap. Rules whose regex has no mandatory trigram look at every text.

Texts are named by a 64-bit hash in the index. Texts of one hash are candidates together, which costs
a look and loses nothing. Copies are one text in the index. Candidates are broadcast if they are few
(counted first). Beyond that a bitmap of fixed size sorts out what is certainly no candidate, and
only the other texts are shuffled; those of hot hashes stay where they are.

Defined results. A null text is an empty one and has no spans. Offsets count code points. Rows are
judged one by one, even if doc_id repeats or is null; every row stays. Long texts are read whole: the
offsets of k matches take about k to the power of 1.5 steps. Other columns pass through; one called
spans, in any case, is replaced. Without rules no text has spans. An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple
from re import _constants as C, _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matches import let
from .common import carried, checkpointed, looked_up, table, written


class Rule(NamedTuple):
    """A kind of secret: its regex, and how long a match, or the group named, must be."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


def either_case(words: str) -> str:
    """A regex with each letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The patterns of the query's contract.
BASE = (
    Rule("assign", either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24),
)
#: Published forms of keys and tokens of common services.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("npm", "npm_[A-Za-z0-9]{36}"),
    Rule("private-key", "-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----"),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("url-login", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@"),
)
RULES = BASE + ADDED

#: Strings and alternatives followed at once while a query is derived; beyond that the query asks for less.
FOLLOWED = 64
#: Candidates up to which they are broadcast (about 100 bytes each), and the bits of the bitmap beyond that.
BROADCAST_ROWS, BITS = 200_000, 1 << 26
#: Matches whose lengths are summed one by one between two sums that are kept.
BLOCK = 64
SPANS = "array<struct<kind:string,start:int,end:int>>"

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative asks for nothing
ANY: Query = frozenset([frozenset()])


def _least(query: Query) -> Query:
    """The query without alternatives that others include."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _either(queries) -> Query:
    return _least(frozenset(itertools.chain.from_iterable(queries)))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > FOLLOWED:
        return min(a, b, key=len)
    return _least(frozenset(x | y for x in a for y in b))


def _holding(strings: set[str]) -> Query:
    """What texts must hold that hold one of the strings."""
    return _either([[frozenset(s[i : i + 3] for i in range(len(s) - 2))] for s in strings])


def _read(parsed) -> tuple[set[str] | None, Query]:
    """The strings that a part of a regex stands for, if they are few, and what any match of it must hold."""
    strings, query, whole = {""}, ANY, True
    for op, value in parsed:
        own, asks = _read_one(op, value)
        if own is not None and len(strings) * len(own) <= FOLLOWED:
            strings = {a + b for a in strings for b in own}
            continue
        query, whole = _both(query, _holding(strings)), False
        strings = {""} if own is None else own
        query = _both(query, asks)
    return (strings, _holding(strings)) if whole else (None, _both(query, _holding(strings)))


def _read_one(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()}, ANY
    if op is C.IN:
        chars = set()
        for kind, own in value:
            if kind is C.LITERAL:
                chars.add(chr(own).lower())
            elif kind is C.RANGE and own[1] - own[0] < 10:
                chars |= {chr(c).lower() for c in range(own[0], own[1] + 1)}
            else:
                return None, ANY
        return (chars, ANY) if len(chars) <= 10 else (None, ANY)
    if op is C.SUBPATTERN:
        return _read(value[3])
    if op is C.BRANCH:
        parts = [_read(p) for p in value[1]]
        strings = None if any(s is None for s, _ in parts) else set().union(*[s for s, _ in parts])
        return (strings if strings is not None and len(strings) <= FOLLOWED else None), _either(q for _, q in parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, part = value
        strings, query = _read(part)
        if most == 1 and strings is not None:
            return strings | ({""} if least == 0 else set()), ANY
        return None, (query if least else ANY)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, ANY
    return None, ANY


def trigram_query(pattern: str) -> Query | None:
    """Alternatives of trigrams, in lower case, of which each match of pattern holds one whole; None if there is nothing that it must hold."""
    _, query = _read(_parser.parse(pattern))
    return None if frozenset() in query else query


def trigram_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of rows (h, text): a posting (trigram, h) for each text and each of the trigrams that it holds."""
    held = let({"low": F.lower("text")}, lambda v: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(v["low"], t)))
    return written(rows.select("h", F.explode(held).alias("trigram")).distinct(), "secret-postings")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(h, kinds): the texts whose postings hold all of an alternative, and the kinds it is of."""
    spark = index.sparkSession
    asked = [(kind, n, t, len(a)) for kind, query in sorted(queries.items()) for n, a in enumerate(sorted(map(sorted, query))) for t in a]
    alternatives = spark.createDataFrame(asked, "kind string, n int, trigram string, size int")  # as many rows as the rules have trigrams
    met = index.join(F.broadcast(alternatives), "trigram").groupBy("h", "kind", "n").agg(F.count("*").alias("held"), F.first("size").alias("size"))
    return checkpointed(met.where("held = size").groupBy("h").agg(F.collect_set("kind").alias("kinds")))


def _bitmap(h: Column, of: DataFrame) -> tuple[DataFrame, Column, Column]:
    """A bitmap of the hashes of `of`, the bucket of h and whether h may be in it."""
    bit = lambda c: F.pmod(c, F.lit(BITS)) + 1
    maps = of.select(bit(F.col("h")).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    at = F.bitmap_bit_position(bit(h)).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return maps, F.bitmap_bucket_number(bit(h)), F.getbit(byte, at % 8) == 1


def with_candidates(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with h) with the kinds that each text is a candidate of, null for none."""
    n = found.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), "h", "left")
    maps, bucket, may = _bitmap(F.col("h"), found)
    known = rows.withColumn("bucket", bucket).join(F.broadcast(checkpointed(maps)), "bucket", "left")  # BITS bits
    known = known.withColumn("may", F.coalesce(may, F.lit(False))).drop("bucket", "bits")
    clear = known.where("NOT may").drop("may").withColumn("kinds", F.lit(None).cast("array<string>"))
    maybe = known.where("may").drop("may")
    return clear.unionByName(looked_up(maybe, found, "h", maybe.count(), "left"))


def _starts(lengths: Column) -> Column:
    """The sum of all lengths before each place: whole blocks by sums that are kept, the rest one by one."""
    total = lambda own: F.aggregate(own, F.lit(0), lambda a, x: a + x)
    upto = lambda own, n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>")) if own is None else F.slice(own, 1, n)

    def summed(v: Column) -> Column:
        blocks = F.transform(upto(None, F.ceil(F.size(v["all"]) / BLOCK).cast("int")), lambda k: total(F.slice(v["all"], k * BLOCK + 1, BLOCK)))
        return let({"all": v["all"], "blocks": blocks}, lambda w: let({"all": w["all"], "before": F.transform(upto(None, F.size(w["blocks"])), lambda k: total(upto(w["blocks"], k)))}, placed))

    def placed(v: Column) -> Column:
        whole = lambda k: F.floor(k / BLOCK).cast("int")
        return F.transform(v["all"], lambda _, k: F.get(v["before"], whole(k)) + total(F.slice(v["all"], whole(k) * BLOCK + 1, k - whole(k) * BLOCK)))

    return let({"all": lengths}, summed)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>>: the matches of the rule in text that are long enough, from left to right without overlap."""
    pattern = F.lit(rule.pattern)
    parts = {"gaps": F.transform(F.split(text, rule.pattern, -1), F.length), "sizes": F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)}
    if rule.group:
        parts["judged"] = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)

    def found(v: Column) -> Column:
        # What comes before a match's end: its gap and itself, and all of those before.
        steps = F.transform(v["sizes"], lambda m, k: m + F.get(v["gaps"], k))
        ends = F.zip_with(_starts(steps), steps, lambda a, b: a + b)
        spans = F.zip_with(ends, v["sizes"], lambda e, m: F.struct(F.lit(rule.kind).alias("kind"), (e - m).alias("start"), e.alias("end")))
        long = v["judged"] if rule.group else v["sizes"]
        return F.filter(spans, lambda s, k: F.get(long, k) >= rule.least)

    return F.when(text.rlike(rule.pattern), let(parts, found)).otherwise(F.array().cast(SPANS))


def _sought(rule: Rule) -> Rule:
    """The rule as it is looked for: where the regex is one class, runs too short are no match from the start."""
    parsed = _parser.parse(rule.pattern)
    if not rule.group and rule.pattern.endswith("]+") and len(parsed) == 1 and parsed[0][0] is C.MAX_REPEAT:
        return rule._replace(pattern=f"{rule.pattern[:-1]}{{{rule.least},}}")  # the same spans: a run of the class is one match or none
    return rule


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without its text, with spans: kind, start and end of every secret, by start and then by the rules' order."""
    row, columns = carried(docs, text, "spans")
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(row, content.alias("text"), F.xxhash64(content).alias("h"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    trigrams = sorted({t for q in queries.values() for a in q for t in a})
    if trigrams:
        rows = with_candidates(rows, candidates(trigram_index(rows.select("h", "text"), trigrams), queries))
    none = F.array().cast(SPANS)
    parts = [F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), _sought(r))).otherwise(none) if r.kind in queries else spans_of(F.col("text"), _sought(r)) for r in rules]
    rank = F.create_map(*itertools.chain.from_iterable((F.lit(r.kind), F.lit(k)) for k, r in enumerate(rules))) if rules else None
    ordered = lambda own: F.transform(F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*columns, (ordered(F.flatten(F.array(*parts))) if rules else none).alias("spans"))


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda own: F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, kinds), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """Every rule over every text, and its matches' places as the sums of what stands before them."""
    found = []
    for k, r in enumerate(rules):
        own = _sought(r).pattern.replace("'", "''")
        size = f"len(regexp_extract_all(text, '{own}', {r.group})[i])"
        found.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s, len(m[i]) AS n "
            f"FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '{own}', 0) AS m, string_split_regex(text, '{own}') AS g FROM d WHERE regexp_matches(text, '{own}'))) "
            f"WHERE {size} >= {r.least}"
        )
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    named = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
own AS (
  SELECT doc_id, {counts}, string_agg({named}, ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})) AS base, string_agg({named}, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(o.n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(o.base, '')) AS base_sha256, coalesce(o.spans, '') AS spans
FROM d LEFT JOIN own o ON d.doc_id = o.doc_id
"""


ORACLE_SQL = oracle_sql()
