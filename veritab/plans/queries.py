"""The engine's operators over the driver's tables, each with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions import scalars as S
from veritab.functions.matches import matches
from veritab.operators import ingest, matrix, relational, review, score
from veritab.sources import writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as facts: concept = part, document = supplier, value = return flag; benign = high discount."""
    return t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_discount") >= 0.08).alias("low"))


FACTS = "f AS (SELECT l_partkey, l_suppkey, l_returnflag, l_orderkey * 10 + l_linenumber AS seq, l_discount >= 0.08 AS low FROM lineitem)"
SETTLED = f"""{FACTS}, c AS (SELECT l_partkey, l_suppkey, l_returnflag, count(*) FILTER (NOT low) AS n, min(seq) FILTER (NOT low) AS s, count(*) AS na, min(seq) AS sa FROM f GROUP BY ALL),
settled AS (SELECT l_partkey, l_suppkey, l_returnflag AS consensus FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END, n DESC, s, na DESC, sa) = 1)"""


@query("SELECT l_partkey, l_suppkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) >= 2")
def intra_drift(spark, sf):
    return relational.disagreeing(facts(spark, sf), ["l_partkey", "l_suppkey"], "l_returnflag")


@query("SELECT o_custkey, o_orderpriority AS consensus FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS s FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, s) = 1")
def consensus_mode(spark, sf):
    return relational.consensus(t(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query(f"WITH {SETTLED} SELECT l_partkey, l_suppkey, consensus FROM settled WHERE l_partkey IN (SELECT l_partkey FROM settled GROUP BY l_partkey HAVING count(*) >= 2 AND count(DISTINCT consensus) >= 2)")
def cross_drift(spark, sf):
    return relational.cross_drift(facts(spark, sf), "l_partkey", "l_suppkey", "l_returnflag", "seq", F.col("low"))


@query(f"WITH {FACTS} SELECT l_partkey, CASE WHEN bool_or(low) AND count(DISTINCT l_returnflag) FILTER (NOT low) < 2 THEN 'downgrade' ELSE 'none' END AS benign FROM f GROUP BY l_partkey")
def benign_mode(spark, sf):
    return relational.benign_mode(facts(spark, sf), ["l_partkey"], "l_returnflag", F.when(F.col("low"), "downgrade"))


@query("SELECT o_orderstatus AS expected, l_linestatus AS value, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus GROUP BY ALL")
def expected_value(spark, sf):
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"))
    met = lines.join(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_linestatus <> o_orderstatus")
    return met.groupBy(F.col("o_orderstatus").alias("expected"), F.col("l_linestatus").alias("value")).agg(F.sum("n").alias("n"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def coverage_gap(spark, sf):
    return relational.uncovered(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), ["doc_id"])


@query("""WITH g AS (SELECT l_suppkey, sum(l_quantity) FILTER (month(l_shipdate) % 2 = 1) AS planned, sum(l_quantity) FILTER (month(l_shipdate) % 2 = 0) AS actual FROM lineitem GROUP BY 1)
SELECT l_suppkey, planned, actual, floor(abs(actual - planned) / planned * 10000 + 0.5) / 10000 AS drift, CASE WHEN abs(actual - planned) / planned < 0.02 THEN 'downgrade' ELSE 'none' END AS benign FROM g WHERE planned > 0 AND actual IS NOT NULL""")
def related_pair(spark, sf):
    odd = F.month("l_shipdate") % 2 == 1
    g = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(odd, F.col("l_quantity"))).alias("planned"), F.sum(F.when(~odd, F.col("l_quantity"))).alias("actual")).where("planned > 0 AND actual IS NOT NULL")
    drift = F.abs(F.col("actual") - F.col("planned")) / F.col("planned")
    return g.select("l_suppkey", "planned", "actual", S.half_up(drift, 4).alias("drift"), F.when(drift < 0.02, "downgrade").otherwise("none").alias("benign"))


@query("""WITH c AS (SELECT p_type, quantile_disc(p_retailprice, 0.1) AS lower, quantile_disc(p_retailprice, 0.9) AS upper FROM part GROUP BY 1),
o AS (SELECT p_type, min(p_retailprice) AS low, max(p_retailprice) AS high FROM part WHERE p_size <= 10 GROUP BY 1)
SELECT p_type, low >= lower AND high <= upper AS met FROM c JOIN o USING (p_type)""")
def verdicts(spark, sf):
    part = t(spark, sf, "part")
    criteria = part.groupBy("p_type").agg(F.expr("percentile_disc(0.1) WITHIN GROUP (ORDER BY p_retailprice)").alias("lower"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY p_retailprice)").alias("upper"))
    observed = part.where("p_size <= 10").groupBy("p_type").agg(F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))
    return criteria.join(observed, "p_type").select("p_type", ((F.col("low") >= F.col("lower")) & (F.col("high") <= F.col("upper"))).alias("met"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS policies, count(*) FILTER (event_type = 'purchase' AND value > 90) AS practices FROM events GROUP BY 1
HAVING count(*) FILTER (event_type = 'error') > 0 AND count(*) FILTER (event_type = 'purchase' AND value > 90) > 0""")
def policy_practice(spark, sf):
    e = t(spark, sf, "events")
    policies = e.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("policies"))
    return policies.join(e.where("event_type = 'purchase' AND value > 90").groupBy("user_id").agg(F.count("*").alias("practices")), "user_id")


@query("""SELECT p_partkey, CASE WHEN p_size = 50 THEN 'MINOR' WHEN p_brand = 'Brand#11' THEN 'CRITICAL' WHEN starts_with(p_brand, 'Brand#1') THEN 'MAJOR' WHEN starts_with(p_brand, 'Brand#') THEN 'MINOR' ELSE 'CRITICAL' END AS severity FROM part""")
def severity_lookup(spark, sf):
    brand = score.lookup(F.col("p_brand"), [("Brand#1", "MAJOR"), ("Brand#", "MINOR")], {"CRITICAL": ["Brand#11"]}, F.lit("CRITICAL"))
    return t(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") == 50, "MINOR").otherwise(brand).alias("severity"))


@query("""SELECT p_partkey, 'r' || min(ord) AS value FROM part LEFT JOIN (VALUES ('s', 1), ('st', 0), ('S', 2), ('P', 3), ('p', 4)) d(prefix, ord) ON starts_with(p_type, prefix) GROUP BY p_partkey""")
def prefix_join(spark, sf):
    table = spark.createDataFrame([("s", 1, "r1"), ("st", 0, "r0"), ("S", 2, "r2"), ("P", 3, "r3"), ("p", 4, "r4")], "prefix string, ord int, value string")
    return relational.prefix_lookup(t(spark, sf, "part").select("p_partkey", "p_type"), "p_type", table).select("p_partkey", "value")


@query("""WITH v AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS support FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey, max(support) AS support FROM v GROUP BY 1),
g AS (SELECT l_partkey, (8 * count(*) + count(*) FILTER (l_tax >= 0.04)) / CAST(10 * count(*) AS DOUBLE) AS spec, count(*) FILTER (l_quantity > 10) / CAST(count(*) AS DOUBLE) AS ctx, count(DISTINCT l_suppkey) AS types FROM lineitem GROUP BY 1),
x AS (SELECT l_partkey, 3e-1 + floor(3e-1 * spec * 1e2 + 5e-1) / 1e2 + floor(15e-2 * ctx * 1e2 + 5e-1) / 1e2 + CASE WHEN support >= 2 THEN 15e-2 ELSE 0e0 END + CASE WHEN types >= 3 THEN 1e-1 ELSE 0e0 END AS total FROM g JOIN s USING (l_partkey))
SELECT l_partkey, least(greatest(floor(total * 7e-1 * 1e2 + 5e-1) / 1e2, 5e-2), 95e-2) AS score FROM x""")
def confidence(spark, sf):
    lines = t(spark, sf, "lineitem")
    support = lines.groupBy("l_partkey", "l_returnflag").agg(F.count_distinct("l_suppkey").alias("support")).groupBy("l_partkey").agg(F.max("support").alias("support"))
    g = lines.groupBy("l_partkey").agg(((8 * F.count("*") + F.count_if(F.col("l_tax") >= 0.04)) / (10 * F.count("*"))).alias("spec"), (F.count_if(F.col("l_quantity") > 10) / F.count("*")).alias("ctx"), F.count_distinct("l_suppkey").alias("types")).join(support, "l_partkey")
    c = score.confidence(F.lit("VALUE_MISMATCH"), F.col("spec"), F.array(F.lit("r")), F.col("ctx"), F.col("support"), F.col("types"), F.lit("mitigate"))
    return g.select("l_partkey", c["score"].alias("score"))


@query("SELECT 'F-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END, p_retailprice DESC, p_name, p_partkey) AS n FROM part)")
def finding_order(spark, sf):
    rank = F.when(F.col("p_type") == "STANDARD", 0).when(F.col("p_type") == "PROMO", 1).otherwise(2)
    return relational.dense_ids(t(spark, sf, "part").select("p_partkey", "p_type", "p_retailprice", "p_name"), [rank, -F.col("p_retailprice"), "p_name", "p_partkey"], "F-", 3).select("id", "p_partkey")


@query("SELECT l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) = 1")
def occurrence_dedupe(spark, sf):
    return relational.first_per_key(t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"), ["l_suppkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderpriority, count(*) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING_n", count(*) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY_n", max(o_totalprice) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING_worst", max(o_totalprice) FILTER (c_mktsegment = 'MACHINERY') AS "MACHINERY_worst"
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def matrix_pivot(spark, sf):
    rows = t(spark, sf, "orders").join(t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderpriority", "c_mktsegment", "o_totalprice")
    out = matrix.pivot(rows, "o_orderpriority", "c_mktsegment", ["BUILDING", "MACHINERY"], n=F.count("o_totalprice"), worst=F.max("o_totalprice"))
    return out.select("o_orderpriority", *[F.coalesce(f"{s}_n", F.lit(0)).alias(f"{s}_n") for s in ("BUILDING", "MACHINERY")], "BUILDING_worst", "MACHINERY_worst")


@query("SELECT o_orderstatus AS severity, o_orderpriority AS scope, count(*) AS n FROM orders GROUP BY ALL")
def severity_scope(spark, sf):
    return matrix.by_severity_and_scope(t(spark, sf, "orders").select(F.col("o_orderstatus").alias("severity"), F.col("o_orderpriority").alias("scope")))


@query("""SELECT o_orderkey, floor(sum(l_extendedprice) * 100 + 0.5) / 100 AS expected, o_totalprice AS stated, CASE WHEN abs(floor(sum(l_extendedprice) * 100 + 0.5) / 100 - o_totalprice) < 0.005 THEN 'CONFIRMED' ELSE 'FAILED' END AS outcome
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice""")
def table_totals(spark, sf):
    sums = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    met = sums.join(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.select("o_orderkey", S.half_up(F.col("s")).alias("expected"), F.col("o_totalprice").alias("stated"), F.when(F.abs(S.half_up(F.col("s")) - F.col("o_totalprice")) < 0.005, "CONFIRMED").otherwise("FAILED").alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS computed, p_retailprice AS stated, CASE WHEN abs(l_extendedprice / l_quantity - p_retailprice) <= 0.5 THEN 'CONFIRMED' ELSE 'FAILED' END AS outcome
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0""")
def ratio_tolerance(spark, sf):
    met = t(spark, sf, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("r")).join(t(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return met.select("l_orderkey", "l_linenumber", S.half_up(F.col("r")).alias("computed"), F.col("p_retailprice").alias("stated"), F.when(F.abs(F.col("r") - F.col("p_retailprice")) <= 0.5, "CONFIRMED").otherwise("FAILED").alias("outcome"))


MASKED = "lower(trim(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))"


@query(f"""SELECT source, key, count(DISTINCT doc_id) AS n_docs FROM (SELECT source, doc_id, {MASKED} AS key FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE key <> '' GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3""")
def boilerplate_lines(spark, sf):
    key = F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", "[0-9]+", "#"), r"[ \t\n\r\f\x0B]+", " ")))
    lines = t(spark, sf, "documents").select("source", "doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("source", "doc_id", key.alias("key")).where("key <> ''")
    return lines.groupBy("source", "key").agg(F.count_distinct("doc_id").alias("n_docs")).where("n_docs >= 3")


@query("SELECT event_id, CASE WHEN regexp_full_match(event_type, 'error|view|X{3,}') THEN '[REDACTED]' ELSE event_type END AS event_type FROM events")
def redaction_tokens(spark, sf):
    return t(spark, sf, "events").select("event_id", F.when(F.col("event_type").rlike("^(?:error|view|X{3,})$"), "[REDACTED]").otherwise(F.col("event_type")).alias("event_type"))


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) > 3600000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_id, sum(start) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY ALL""")
def reflow_islands(spark, sf):
    e = t(spark, sf, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(w)
    starts = before.isNull() | (F.timestamp_diff("MICROSECOND", before, F.col("ts")) > 3600000000)
    return relational.islands(e, ["user_id"], ["ts", "event_id"], starts).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""WITH r AS (SELECT user_id, event_id, (event_id // 100) % 7 - (row_number() OVER (PARTITION BY user_id ORDER BY event_id)) % 5 AS off FROM events)
SELECT user_id, off AS "pageOffset" FROM (SELECT user_id, off, count(*) AS n, min(event_id) AS s FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) = 1""")
def modal_offset(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t(spark, sf, "events").select("user_id", "event_id", (F.expr("event_id div 100") % 7 - n % 5).alias("off"))
    return relational.consensus(rows, ["user_id"], "off", "event_id", out="pageOffset")


@query("""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k FROM events WHERE value IS NOT NULL),
b AS (SELECT user_id, k, value AS anchor, 1 AS n FROM r WHERE k = 1 UNION ALL
  SELECT r.user_id, r.k, CASE WHEN r.value > b.anchor + 2.2e0 THEN r.value ELSE b.anchor END, CASE WHEN r.value > b.anchor + 2.2e0 THEN b.n + 1 ELSE b.n END FROM b JOIN r ON r.user_id = b.user_id AND r.k = b.k + 1)
SELECT user_id, n AS line, count(*) AS items FROM b GROUP BY ALL""")
def line_assembly(spark, sf):
    counts = t(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id", "value").agg(F.count("*").alias("items"))
    counts = relational.cut(counts)
    lines = relational.anchored_rows(counts, ["user_id"], "value", 2.2, "line")
    return counts.join(lines, ["user_id", "value"]).groupBy("user_id", "line").agg(F.sum("items").alias("items"))


ROW = r"^([^ ]{1,8}) +([^ ].{3,})$"


@query(f"""SELECT doc_id, regexp_extract(line, '{ROW}', 1) AS acronym, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
WHERE regexp_matches(line, '{ROW}') AND (len(regexp_extract_all(regexp_extract(line, '{ROW}', 1), '[A-Z]')) >= 2 OR (len(regexp_extract_all(regexp_extract(line, '{ROW}', 1), '[A-Z]')) = 1 AND length(regexp_extract(line, '{ROW}', 1)) <= 4)) GROUP BY ALL""")
def abbreviations(spark, sf):
    lines = t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.col("line").rlike(ROW))
    token = F.regexp_extract("line", ROW, 1)
    capitals = F.regexp_count(token, F.lit("[A-Z]"))
    return lines.where((capitals >= 2) | ((capitals == 1) & (F.length(token) <= 4))).groupBy("doc_id", token.alias("acronym")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, p AS rule, count(*) AS n FROM documents, (VALUES ('[A-Z][a-z]+ation'), ('[0-9]{3,}'), ('[Ll]icen[sc]e')) d(p), unnest(regexp_extract_all(text, p)) u(m) GROUP BY ALL""")
def extract_all(spark, sf):
    patterns = ["[A-Z][a-z]+ation", "[0-9]{3,}", "[Ll]icen[sc]e"]
    hits = F.flatten(F.array(*[_named(p) for p in patterns]))
    return t(spark, sf, "documents").select("doc_id", F.inline(hits)).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def _named(p: str):
    return F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(p).alias("rule"), m.alias("m")))


@query("""SELECT doc_id, CAST(length(string_split_regex(text, '[0-9]{3,}')[1]) AS INTEGER) AS first_index, regexp_extract(text, '[0-9]{3,}') AS first_match, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS INTEGER) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3,}')""")
def hit_offsets(spark, sf):
    found = t(spark, sf, "documents").select("doc_id", matches(F.col("text"), "[0-9]{3,}").alias("h")).where(F.size("h") > 0)
    return found.select("doc_id", F.get("h", F.lit(0))["index"].alias("first_index"), F.get(F.get("h", F.lit(0))["m"], F.lit(0)).alias("first_match"), F.size("h").alias("n"))


@query("""SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 21 THEN 'twenty-one' WHEN 40 THEN 'forty' ELSE CAST(p_size AS VARCHAR) END AS word, CAST(p_size AS DOUBLE) AS number FROM part""")
def number_words(spark, sf):
    word = F.when(F.col("p_size") == 1, "one").when(F.col("p_size") == 21, "twenty-one").when(F.col("p_size") == 40, "forty").otherwise(F.col("p_size").cast("string"))
    return t(spark, sf, "part").select("p_partkey", word.alias("word"), S.to_number(word).alias("number"))


SUFFIXES = " ".join(f"WHEN length(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)})" for s in S.SUFFIXES)
STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


@query(f"""SELECT item_id, CASE {SUFFIXES} ELSE w END AS token, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+')) AS w FROM benchmark) WHERE w <> '' AND w NOT IN ({STOPS}) GROUP BY ALL""")
def tokens_stem(spark, sf):
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return t(spark, sf, "benchmark").select("item_id", F.explode(S.content_tokens(low)).alias("token")).groupBy("item_id", "token").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[0-9_]', '', 'g'), '(p?n)$', '') AS base FROM part)
SELECT p_partkey, CASE WHEN length(regexp_replace(base, '[aeiou]', '', 'g')) >= 2 THEN regexp_replace(base, '[aeiou]', '', 'g') ELSE base END AS root FROM b""")
def identifier_root(spark, sf):
    return t(spark, sf, "part").select("p_partkey", S.identifier_root(F.col("p_name")).alias("root"))


LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""WITH dw AS (SELECT DISTINCT source, w FROM (SELECT source, unnest(string_split_regex({LOWER.format('text')}, '[^a-z0-9]+')) AS w FROM documents) WHERE w <> '' AND w NOT IN ({STOPS})),
d AS (SELECT DISTINCT source, CASE {SUFFIXES} ELSE w END AS o FROM dw),
i AS (SELECT item_id, unnest(string_split_regex({LOWER.format('text')}, '[^a-z0-9]+')) AS w FROM benchmark), k AS (SELECT item_id, CASE {SUFFIXES} ELSE w END AS token, count(*) AS n FROM i WHERE w <> '' AND w NOT IN ({STOPS}) GROUP BY ALL),
v AS (SELECT DISTINCT token FROM k),
starts AS (SELECT token, left(token, j) AS x FROM (SELECT token, unnest(generate_series(1, length(token))) AS j FROM v)),
ends AS (SELECT source, left(o, j) AS x FROM (SELECT source, o, unnest(generate_series(1, length(o))) AS j FROM d)),
met AS (SELECT token, source FROM starts JOIN d ON x = o UNION SELECT token, source FROM v JOIN ends ON x = token),
s AS (SELECT item_id, source, sum(n) AS shared FROM k JOIN met USING (token) GROUP BY ALL)
SELECT item_id, source, CAST(shared AS BIGINT) AS shared FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, source) = 1""")
def crossref_argmax(spark, sf):
    """The source whose texts share most with an item, over whole texts: each token of the item that prefix-matches one of the source's."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = t(spark, sf, "documents").select("source", F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("w")).distinct()
    tokens = words.where((F.length("w") > 0) & ~F.col("w").isin(S.STOP_WORDS)).select("source", S.stem(F.col("w")).alias("o"))  # a stem for each distinct word
    items = t(spark, sf, "benchmark").select("item_id", F.explode(S.content_tokens(low)).alias("token"))
    return relational.most_shared(items.groupBy("item_id", "token").agg(F.count("*").alias("n")), "item_id", "token", "n", tokens, "source", "o")


HOST = r"://([a-z0-9.-]+)"


@query(f"""WITH RECURSIVE h AS (SELECT regexp_extract(url, '{HOST}', 1) AS host, min(page_id) AS id FROM pages GROUP BY 1), tok AS (SELECT id, list_filter(string_split_regex(host, '[^a-z0-9]+'), lambda x: x <> '') AS t FROM h),
e AS (SELECT a.id AS a, b.id AS b FROM tok a JOIN tok b ON a.id < b.id WHERE len(list_filter(a.t, lambda x: len(list_filter(b.t, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.6),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS root FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def name_clusters(spark, sf):
    hosts = t(spark, sf, "pages").groupBy(F.regexp_extract("url", HOST, 1).alias("host")).agg(F.min("page_id").alias("id"))
    tokens = hosts.select("id", F.filter(F.split("host", "[^a-z0-9]+"), lambda x: x != "").alias("tok"))
    return relational.components(relational.similar_pairs(tokens, "id", "tok", 0.6))


@query("""SELECT doc_id, substr(text, greatest(strpos(text, 'tion') - 121, 0) + 1, least(strpos(text, 'tion') - 1 + 124, length(text)) - greatest(strpos(text, 'tion') - 121, 0)) AS snippet FROM documents WHERE strpos(text, 'tion') > 0""")
def snippets(spark, sf):
    at = F.expr("instr(text, 'tion')") - 1
    low = F.greatest(at - 120, F.lit(0))
    return t(spark, sf, "documents").where(at >= 0).select("doc_id", F.substr(F.col("text"), low + 1, F.least(at + 124, F.length("text")) - low).alias("snippet"))


AUDIT = """e AS (SELECT 'AE-' || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END AS id, * FROM (SELECT row_number() OVER (ORDER BY event_id) AS n, event_id, user_id, event_type, props FROM events WHERE event_type = 'error'))"""


def _audit(spark, sf):
    rows = t(spark, sf, "events").where("event_type = 'error'").select("event_id", F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("eventType"), F.col("props").alias("detail"))
    return review.numbered(rows, ["event_id"])


@query(f"WITH {AUDIT} SELECT id, CAST(user_id AS VARCHAR) AS actor, props AS detail FROM e")
def audit_log(spark, sf):
    return _audit(spark, sf).select("id", "actor", "detail")


@query(f"""WITH {AUDIT} SELECT id, '"' || id || '","' || '","' || CAST(user_id AS VARCHAR) || '","' || event_type || '","' || replace(coalesce(props, ''), '"', '""') || '","1.0"' AS line FROM e""")
def audit_csv(spark, sf):
    return writers.csv_lines(_audit(spark, sf).withColumns({"timestamp": F.lit(""), "rulesetVersion": F.lit("1.0")}))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'OPEN' WHEN l.quality = 1 THEN 'CONFIRMED' ELSE 'DISMISSED' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def disposition_latest(spark, sf):
    said = t(spark, sf, "labels").select(F.col("doc_id").alias("findingId"), F.when(F.col("quality") == 1, "CONFIRMED").otherwise("DISMISSED").alias("status"), F.lit("r").alias("reviewer"), F.lit("").alias("comment"), F.lit("").alias("timestamp"))
    return review.reviewed(t(spark, sf, "documents").select(F.col("doc_id").alias("id")), said).select(F.col("id").alias("doc_id"), F.coalesce("disposition.status", F.lit("OPEN")).alias("status"))


@query("SELECT source, count(*) FILTER (l.doc_id IS NULL) AS open, count(*) FILTER (l.doc_id IS NULL) = 0 AS may_sign FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def signoff_gate(spark, sf):
    left = relational.uncovered(t(spark, sf, "documents").select("doc_id", "source"), t(spark, sf, "labels"), ["doc_id"]).groupBy("source").agg(F.count("*").alias("n"))
    every = t(spark, sf, "documents").select("source").distinct()
    return every.join(left, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("open"), (F.coalesce("n", F.lit(0)) == 0).alias("may_sign"))


@query("SELECT l_orderkey, l_linenumber, floor(l_discount * l_extendedprice * 100 + 0.5) / 100 AS rounded, least(greatest(l_tax, 0.02), 0.06) AS clamped FROM lineitem")
def rounding(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.half_up(F.col("l_discount") * F.col("l_extendedprice")).alias("rounded"), S.clamp(F.col("l_tax"), 0.02, 0.06).alias("clamped"))


@query("SELECT DISTINCT 'category' AS menu, c_mktsegment AS value FROM customer UNION SELECT 'document', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def filter_menus(spark, sf):
    rows = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("category"), F.array("n_name").alias("documentTypes"))
    return matrix.menus(rows)


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text FROM conversations) GROUP BY 1")
def reflow_text(spark, sf):
    clean = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    rows = t(spark, sf, "conversations").select("conv_id", "turn", clean.alias("text"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))


@query("""SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) + (SELECT count(*) FROM region) + 4 AS "conceptsCompared" """)
def concepts_compared(spark, sf):
    from veritab.operators.compare import concepts_compared as count

    return count(t(spark, sf, "lineitem").select(F.col("l_partkey").alias("conceptKey")), t(spark, sf, "region"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), 'sap') THEN 'SAP' WHEN regexp_matches(lower(url), 'csr') THEN 'CSR' WHEN regexp_matches(lower(url), 'crf') THEN 'CRF' WHEN regexp_matches(lower(url), 'brochure|ib') THEN 'IB' ELSE 'PROTOCOL' END AS type FROM pages")
def document_types(spark, sf):
    from veritab.sources.readers import document_type

    return t(spark, sf, "pages").select("page_id", document_type(F.col("url")).alias("type"))


@query("""SELECT item_id, regexp_replace(replace(replace(replace(replace(translate(text, '‘’“”–—−', '''''""---'), '≥', '>='), '≤', '<='), '…', '...'), '•', '-'), '[^\\x{00}-\\x{FF}]', '?', 'g') AS text FROM benchmark""")
def glyphs(spark, sf):
    from veritab.sources.fixtures import sanitized

    return t(spark, sf, "benchmark").select("item_id", sanitized(F.col("text")).alias("text"))


@query("""SELECT doc_id, count(*) FILTER (regexp_matches(line, '^[0-9]+(?:\\.[0-9]+)*\\.?[ \\t]+[^ \\t]')) AS numbered, count(*) FILTER (regexp_matches(line, '^[^a-z]*[A-Z][^a-z]*$')) AS capitals
FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE length(line) BETWEEN 3 AND 120 GROUP BY doc_id""")
def heading_lines(spark, sf):
    lines = t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).select("doc_id", F.trim("line").alias("line")).where(F.length("line").between(3, 120))
    return lines.groupBy("doc_id").agg(F.count_if(F.col("line").rlike(r"^[0-9]+(?:\.[0-9]+)*\.?[ \t]+[^ \t]")).alias("numbered"), F.count_if(F.col("line").rlike("^[^a-z]*[A-Z][^a-z]*$")).alias("capitals"))


@query("SELECT CAST(floor(value / 6e0 + 5e-1) AS BIGINT) AS band, count(*) AS n FROM events GROUP BY 1")
def repetition_band(spark, sf):
    return t(spark, sf, "events").groupBy(ingest.band(F.col("value")).alias("band")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page FROM events)
SELECT user_id, page, CASE WHEN event_id % 3 = 0 THEN page - 2 WHEN page - 2 >= 1 THEN page - 2 END AS printed FROM f WHERE event_id % 3 <> 0 OR page > 2""")
def printed_pages(spark, sf):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t(spark, sf, "events").select("user_id", "event_id", n.alias("page")).where("event_id % 3 <> 0 OR page > 2").select(F.col("user_id").cast("string").alias("documentId"), F.col("page").alias("pdfPage"), "event_id")
    said = rows.where("event_id % 3 = 0").select("documentId", "pdfPage", (F.col("pdfPage") - 2).alias("printed"))
    documents = rows.select("documentId", F.lit(2).alias("pageOffset")).distinct()
    out = ingest.printed_pages(rows, said, documents)
    return out.select(F.col("documentId").cast("long").alias("user_id"), F.col("pdfPage").cast("long").alias("page"), F.col("printedPage").cast("long").alias("printed"))


@query("""WITH g AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS gap FROM events)
SELECT user_id, 128e-2 * min(gap) FILTER (gap > 1) AS threshold FROM g GROUP BY 1 HAVING min(gap) FILTER (gap > 1) IS NOT NULL""")
def paragraph_threshold(spark, sf):
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    return t(spark, sf, "events").select("user_id", gap.alias("gap")).groupBy("user_id").agg((ingest.PARAGRAPH * F.min(F.when(F.col("gap") > 1, F.col("gap")))).alias("threshold")).where("threshold IS NOT NULL")


@query("""WITH s AS (SELECT user_id, event_type, value, event_id, coalesce(value - lag(value) OVER w > 2, false) AS apart, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
SELECT user_id, string_agg(CASE WHEN apart THEN ' ' || event_type ELSE event_type END, '' ORDER BY k) AS text FROM s GROUP BY 1""")
def gap_spacing(spark, sf):
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    rows = t(spark, sf, "events").select("user_id", F.row_number().over(w).alias("k"), F.concat(F.when(F.col("value") - F.lag("value").over(w) > 2, " ").otherwise(""), "event_type").alias("t"))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("text"))


@query("""WITH i AS (SELECT DISTINCT l_suppkey, l_returnflag AS name FROM lineitem WHERE l_linenumber = 1), c AS (SELECT DISTINCT l_suppkey, l_returnflag AS name FROM lineitem WHERE l_linenumber = 7),
x AS (SELECT * FROM i EXCEPT SELECT * FROM c) SELECT s.s_suppkey, CASE WHEN count(x.name) > 1 THEN count(x.name) || ' UNRELATED INPUTS — ' || string_agg(x.name, ', ' ORDER BY x.name) ELSE 'SINGLE INPUT' END AS value FROM supplier s LEFT JOIN x ON s.s_suppkey = x.l_suppkey GROUP BY 1""")
def dataset_flow(spark, sf):
    names = lambda k: F.collect_set(F.when(F.col("l_linenumber") == k, F.col("l_returnflag")))
    flow = t(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.array_except(names(1), names(7))).alias("x"))
    every = t(spark, sf, "supplier").select("s_suppkey").join(flow, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return every.select("s_suppkey", F.when(F.size("x") > 1, F.concat(F.size("x").cast("string"), F.lit(" UNRELATED INPUTS — "), F.array_join("x", ", "))).otherwise("SINGLE INPUT").alias("value"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE regexp_full_match(w, '-?[0-9]+(\\.[0-9]+)?') GROUP BY 1")
def stray_literals(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "[ \n]+", -1)).alias("w")).where(F.col("w").rlike(r"^-?[0-9]+(\.[0-9]+)?$")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT item_id, unnest(string_split(text, '.')) AS s FROM benchmark), a(key, p) AS (VALUES ('lvef', 'tion'), ('ecg', 'the')), m(tp, q) AS (VALUES ('c1d1', 'in'), ('eot', 'er'))
SELECT item_id, 'assessment.' || key || '.' || tp AS "conceptKey", count(*) AS n FROM s, a, m WHERE contains(s, p) AND contains(s, q) GROUP BY ALL""")
def assessment_timepoints(spark, sf):
    sentences = t(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", r"\.", -1)).alias("s"))
    pairs = F.flatten(F.array(*[F.when(F.col("s").contains(p) & F.col("s").contains(q), F.array(F.lit(f"assessment.{key}.{at}"))).otherwise(F.array().cast("array<string>")) for key, p in (("lvef", "tion"), ("ecg", "the")) for at, q in (("c1d1", "in"), ("eot", "er"))]))
    return sentences.select("item_id", F.explode(pairs).alias("conceptKey")).groupBy("item_id", "conceptKey").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, 'GTE ' || p_size || ' days' AS threshold, p_size || '% CI (two-sided)' AS level, '[-' || p_size || ', ' || p_size || ']' AS "interval", '+/-' || p_size || ' days' AS tolerance, 'c' || p_size || 'd1' AS timepoint, 'Q' || p_size || 'D' AS frequency,
'alpha ' || CASE WHEN p_size % 100 = 0 THEN CAST(p_size // 100 AS VARCHAR) ELSE CAST(p_size / 1e2 AS VARCHAR) END || ' (one-sided)' AS alpha FROM part""")
def normalized_values(spark, sf):
    n = F.col("p_size").cast("string")
    return t(spark, sf, "part").select(
        "p_partkey", S.threshold(F.lit("at least"), n, F.lit("Day")).alias("threshold"), S.ci_level(n, F.lit("two")).alias("level"), S.interval(F.concat(F.lit("-"), n), n).alias("interval"), S.tolerance(n, F.lit("d")).alias("tolerance"),
        S.timepoint(F.concat(F.lit("Cycle "), n, F.lit(" Day 1"))).alias("timepoint"), S.frequency(F.concat(F.lit("every "), n, F.lit(" days"))).alias("frequency"), S.alpha(n, F.lit("One"), percent=True).alias("alpha"))


@query("SELECT p_type, count(DISTINCT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g')) = 1 AS case_only FROM part GROUP BY 1")
def case_only(spark, sf):
    return t(spark, sf, "part").groupBy("p_type").agg(F.collect_set("p_brand").alias("v")).select("p_type", S.only_case_or_punctuation(F.col("v")).alias("case_only"))


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, list_sort(list_distinct(list(l_linestatus))) AS types, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT l_suppkey, string_agg(array_to_string(types, ', ') || CASE WHEN len(types) = 1 THEN ' states ' ELSE ' state ' END || l_returnflag, '; ' ORDER BY first, l_returnflag) || '.' AS description FROM v GROUP BY 1""")
def variant_description(spark, sf):
    v = t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.array_sort(F.collect_set("l_linestatus")).alias("types"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    said = F.concat(F.array_join("types", ", "), F.when(F.size("types") == 1, " states ").otherwise(" state "), "l_returnflag")
    return v.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("first", "l_returnflag", said.alias("s")))).alias("l")).select("l_suppkey", F.concat(F.array_join(F.transform("l", lambda x: x["s"]), "; "), F.lit(".")).alias("description"))


@query("SELECT count(*) AS findings, count(*) FILTER (o_orderstatus = 'F') AS critical, count(*) FILTER (o_orderstatus = 'O') AS major, count(*) FILTER (o_orderstatus = 'P') AS minor, (SELECT count(*) FROM part) AS checks, (SELECT count(*) FROM part WHERE p_size > 10) AS confirmed FROM orders")
def run_summary(spark, sf):
    severity = F.when(F.col("o_orderstatus") == "F", "CRITICAL").when(F.col("o_orderstatus") == "O", "MAJOR").otherwise("MINOR")
    checks = t(spark, sf, "part").select(F.when(F.col("p_size") > 10, "CONFIRMED").otherwise("FAILED").alias("outcome"))
    return matrix.run_summary(t(spark, sf, "orders").select(severity.alias("severity")), checks)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 50 AND (user_id % 3) = 0")
def findings_filter(spark, sf):
    rows = t(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("severity"), F.when(F.col("value") > 50, "HIGH").otherwise("LOW").alias("category"), F.array((F.col("user_id") % 3).cast("string")).alias("documentTypes"), F.lit(None).cast("struct<status:string>").alias("disposition"))
    return review.filtered(rows, severity="error", category="HIGH", document="0", status="OPEN").select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber, bool_or(l_discount >= 0.1) OVER (PARTITION BY l_orderkey) AS expected_route FROM lineitem WHERE l_quantity <> 7")
def concept_routing(spark, sf):
    w = Window.partitionBy("l_orderkey")
    return t(spark, sf, "lineitem").where("l_quantity <> 7").select("l_orderkey", "l_linenumber", F.bool_or(F.col("l_discount") >= 0.1).over(w).alias("expected_route"))


def no_context(spark):
    from veritab.model import ABBREVIATIONS, SECTIONS

    return spark.createDataFrame([], SECTIONS), spark.createDataFrame([], ABBREVIATIONS)
