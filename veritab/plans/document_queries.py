"""Documents in order, filled pages, planted items and text operators over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritab.plans.queries import query, t
from veritab.plans.scratch import shared_dir
from veritab.sources import document_sink


@query("""SELECT row_number() OVER (ORDER BY l, k) AS line, list, key, name FROM (
SELECT 0 AS l, c_custkey AS k, 'customers' AS list, c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT 1, -o_orderkey, 'orders', o_orderkey, o_orderpriority FROM orders)""")
def json_document(spark, sf):
    """Customers, and orders downwards, written as one JSON document and read back by its lines."""
    path = f"{shared_dir(spark).rstrip('/')}/document-{uuid.uuid4().hex}.json"
    customers = t(spark, sf, "customer").select(F.lit("customers").alias("list"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    orders = t(spark, sf, "orders").select(F.lit("orders").alias("list"), F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("name"))
    document_sink.json_lists({"of": "the tables"}, [("customers", customers, ["key"]), ("orders", orders, [-F.col("key")])], {"signOff": None}, path)
    # The lines' places in the file follow from the order of its splits.
    from veritab.operators import relational

    lines = relational.cut(spark.read.text(path).withColumn("_at", F.col("_metadata.file_block_start")).withColumn("_i", F.monotonically_increasing_id()))
    own = lines.where(F.col("value").startswith('{"list"')).select("_at", "_i", F.from_json(F.regexp_replace("value", ",$", ""), "list string, key bigint, name string").alias("v"))
    return relational.dense_numbers(own, ["_at", "_i"], "line").select("line", "v.list", "v.key", "v.name")


#: Parts as findings and as planted items; figures in hundredths, so that both dialects say the same.
PLANTED = """f AS (SELECT 'F-' || p_partkey AS id, p_brand AS concept, CASE WHEN p_size % 2 = 0 THEN 'CROSS_DOCUMENT' ELSE 'INTRA_DOCUMENT' END AS scope, CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MAJOR' ELSE 'MINOR' END AS severity,
  (p_size % 20 * 5) / 1e2 AS confidence, p_size % 5 > 0 AS noted, p_name || ' of ' || p_type || ' size ' || p_size || ' ' || p_type || ' raw ' || p_name || ' in ' || p_brand AS said FROM part),
m AS (SELECT n_nationkey * 1000 + r_regionkey * 100 + k AS no, 'Brand#' || (n_nationkey + 1) AS concept, CASE r_regionkey WHEN 0 THEN 'CROSS_DOCUMENT' WHEN 1 THEN 'INTRA_DOCUMENT' END AS scope, CASE k % 3 WHEN 0 THEN 'DECOY' ELSE 'FINDING' END AS kind,
  CASE k % 3 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' ELSE 'CRITICAL' END AS severity, CASE k WHEN 0 THEN NULL WHEN 1 THEN 'widget of' WHEN 2 THEN '7' WHEN 3 THEN 'PROMO raw' WHEN 4 THEN 'size 1' ELSE 'nowhere' END AS evidence FROM nation, region, range(6) t(k))"""


def planted(spark, sf):
    """(findings, manifest) of the tables: a finding for each part, an item for each nation, region and text."""
    e = F.expr
    findings = t(spark, sf, "part").select(
        e("concat('F-', p_partkey) AS id"), e("p_brand AS conceptKey"), e("CASE WHEN p_size % 2 = 0 THEN 'CROSS_DOCUMENT' ELSE 'INTRA_DOCUMENT' END AS scope"), e("CASE p_size % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MAJOR' ELSE 'MINOR' END AS severity"),
        e("(p_size % 20 * 5) / 100D AS confidence"), e("CASE WHEN p_size % 5 > 0 THEN 'noted' END AS benignNote"), e("p_name AS title"), e("concat('of ', p_type, ' size ', p_size) AS description"),
        e("array(named_struct('entityId', '', 'value', p_type, 'rawText', concat('raw ', p_name), 'citation', named_struct('snippet', concat('in ', p_brand)))) AS occurrences"), e("repeat('c', 41) AS regulatoryContext"), e("repeat('a', 21) AS suggestedAction"))
    texts = t(spark, sf, "nation").select("n_nationkey").crossJoin(F.broadcast(t(spark, sf, "region").select("r_regionkey"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))  # five regions
    manifest = texts.select(
        e("CAST(n_nationkey * 1000 + r_regionkey * 100 + k AS string) AS id"), e("'' AS summary"), e("CASE k % 3 WHEN 0 THEN 'DECOY' ELSE 'FINDING' END AS kind"), e("CASE k % 3 WHEN 0 THEN 'MINOR' WHEN 1 THEN 'MAJOR' ELSE 'CRITICAL' END AS severity"), e("concat('Brand#', n_nationkey + 1) AS conceptKey"),
        e("CASE r_regionkey WHEN 0 THEN 'CROSS_DOCUMENT' WHEN 1 THEN 'INTRA_DOCUMENT' END AS scope"), e("CASE k WHEN 1 THEN 'widget of' WHEN 2 THEN '7' WHEN 3 THEN 'PROMO raw' WHEN 4 THEN 'size 1' WHEN 5 THEN 'nowhere' END AS evidence"), e("CAST(NULL AS string) AS arithmetic"), e("CAST(NULL AS int) AS resolvedCrossReferences"))
    return findings, manifest


@query(f"""WITH {PLANTED}, j AS (SELECT no, kind, m.severity AS wanted, f.* EXCLUDE (concept, scope) FROM m LEFT JOIN f ON m.concept = f.concept AND (m.scope IS NULL OR m.scope = f.scope) AND contains(f.said, coalesce(m.evidence, ''))),
o AS (SELECT no, kind, count(id) AS found, bool_or(severity = wanted) AS graded, max(confidence) AS most, min(confidence) AS least, arg_min(severity, (confidence, length(id), id)) AS low, arg_min(noted, (confidence, length(id), id)) AS noted FROM j GROUP BY ALL)
SELECT CAST(no AS VARCHAR) AS id, kind, found, CASE kind WHEN 'DECOY' THEN least ELSE most END AS confidence, CASE kind WHEN 'DECOY' THEN coalesce(least < 5e-1 AND low = 'MINOR' AND noted, false) ELSE coalesce(graded AND most >= 5e-1, false) END AS met FROM o""")
def planted_items(spark, sf):
    """What was found of each planted item."""
    from veritab.operators import golden

    return golden.outcomes(*planted(spark, sf)).select("id", "kind", "found", "confidence", "met")


@query(f"""WITH {PLANTED}, s AS (SELECT * FROM f WHERE confidence >= 5e-1)
SELECT (SELECT count(*) FROM s) AS sure, (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM m WHERE kind = 'FINDING' AND m.concept = s.concept AND (m.scope IS NULL OR m.scope = s.scope) AND contains(s.said, coalesce(m.evidence, '')))) AS planted,
  (SELECT count(*) FROM s WHERE EXISTS (SELECT 1 FROM m WHERE kind = 'FINDING' AND m.concept = s.concept AND (m.scope IS NULL OR m.scope = s.scope) AND contains(s.said, coalesce(m.evidence, '')))) / (SELECT count(*) FROM s) AS "precision" """)
def planted_precision(spark, sf):
    """The share of sure findings that were planted."""
    from veritab.operators import golden

    return golden.precision(*planted(spark, sf))


@query()
def filled_pages(spark, sf):
    """The map of the pages that the whole texts of all documents fill, one paragraph each under a heading."""
    from veritab.sources import filling

    docs = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("documentId"), "source", "text")
    blocks = docs.select("documentId", F.explode(F.array(F.struct(F.lit(0).alias("blockSeq"), F.lit("heading").alias("kind"), F.col("source").alias("text")), F.struct(F.lit(1).alias("blockSeq"), F.lit("para").alias("kind"), F.col("text")))).alias("b")).select("documentId", "b.*", F.lit(None).cast("array<string>").alias("rows"))
    documents = docs.select(F.col("documentId").alias("id"), F.lit("SAP").alias("type"), *[F.lit("").alias(c) for c in ("fileName", "title", "version", "effectiveDate", "author")], F.lit(0).alias("docSeq"), F.lit("").alias("header"), F.lit(1).alias("leaves"))
    return filling.corpus(documents, blocks)["page_map"].select("documentId", "pdfPages", "printedPages", "pageOffset")


@query("""SELECT 'C' || o_custkey AS doc, row_number() OVER w - 1 AS seq, o_orderpriority AS text, 10 + 2 * sum(o_orderkey % 7) OVER w AS x, 20 - 24 * row_number() OVER w AS y, 10 * length(o_orderpriority) AS width, 20 AS height, 0 AS turn
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)""")
def text_items(spark, sf):
    """Orders of each customer as text operators under a matrix of scale two, as positioned items."""
    from veritab.sources import text_state

    orders = t(spark, sf, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("documentId"), "o_custkey", "o_orderkey", "o_orderpriority")
    nothing = {"args": F.array().cast("array<double>"), "font": F.lit(None).cast("string"), "text": F.lit(None).cast("string"), "advance": F.lit(None).cast("double")}
    op = lambda df, seq, name, **own: df.select("documentId", F.lit(1).alias("pdfPage"), seq.cast("long").alias("opSeq"), F.lit(name).alias("op"), *[own.get(k, v).alias(k) for k, v in nothing.items()])
    numbers = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    heads = orders.select("documentId").distinct()
    parts = [op(heads, F.lit(-3), "cm", args=numbers(2, 0, 0, 2, 10, 20)), op(heads, F.lit(-2), "BT"), op(heads, F.lit(-1), "Tf", args=numbers(10), font=F.lit("F"))]
    parts += [op(orders, F.col("o_orderkey") * 2, "Td", args=F.array((F.col("o_orderkey") % 7).cast("double"), F.lit(-12.0))), op(orders, F.col("o_orderkey") * 2 + 1, "Tj", text=F.col("o_orderpriority"), advance=F.length("o_orderpriority") * 500.0)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    whole = lambda c: F.round(c).cast("long").alias(c)
    return text_state.items_of(rows).select(F.col("documentId").alias("doc"), F.col("itemSeq").cast("long").alias("seq"), "text", whole("x"), whole("y"), whole("width"), whole("height"), F.col("rotation").alias("turn"))
