"""URL filters: host and path rules, and link-graph propagation for pages that no rule judges.

Trust starts from hosts with pages that a rule allows and follows links (personalised PageRank);
distrust starts from hosts with pages that a rule blocks and follows links backwards. Both are in
pages: a seed's weight is its number of such pages. A host whose distrust is over THRESHOLD of
both together is blocked. Propagation goes on until the masses change by less than TOLERANCE (the
SQL's ROUNDS steps suffice for small, shallow graphs only). All of it is DataFrame operations over host edges that are counted
before they are shuffled; hosts, links and ranks stay distributed.

Defined results. A null url, or one without "://", has an empty host and path, takes no part in
the graph and is allowed unless a rule fits. Links are absolute href values; links within a host
count for nothing. Mass of hosts without links ends there. Rows are judged one by one, even if
page_id repeats or is null; other columns pass through, but for html and those called like an output.
A very long html is read whole; an empty table gives an empty one. A null html has no links. Rules of equal length rank by their text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, table
from .decontaminate import LOWER, UPPER

#: (verdict, rule); a rule is a host and the start of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, ROUNDS, THRESHOLD = 0.85, 10, 0.5
#: Propagation ends when trust and distrust change by less than this share of all seeds' mass.
TOLERANCE = 1e-9
#: Steps of propagation between checkpoints.
EVERY = 2
#: Hosts' verdicts are broadcast up to this many hosts.
BROADCAST_ROWS = 100_000
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)href[ \t\r\n\f]*=[ \t\r\n\f]*[\"']?[ \t\r\n\f]*(?:https?:)?//([^/?#\"'<> \t\r\n\f]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        here = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits = F.when(here, value) if fits is None else fits.when(here, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if fits is None else fits


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and the rule's verdict."""
    cut = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    found = rule_of(F.col("host"), F.col("path"), rules)
    return cut.withColumns({"rule": found["rule"], "verdict": found["verdict"]})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages of a host to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("to"))
    return links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def host_mass(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) after rounds steps of propagation, or without rounds when it has converged."""
    seeds = judged.where("host <> '' AND verdict IS NOT NULL").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").cast("double").alias("st"), F.count_if(F.col("verdict") == "block").cast("double").alias("sd"))
    edges = checkpointed(edges)
    start = seeds.select("host", (F.col("st") * (1 - damping)).alias("bt"), (F.col("sd") * (1 - damping)).alias("bd"))
    if not edges.take(1):
        return start.select("host", F.col("bt").alias("trust"), F.col("bd").alias("distrust"))
    start = checkpointed(start)
    out = edges.groupBy("src").agg(F.sum("n").alias("of"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("of"))
    zero = F.lit(0.0)
    forward = edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("of")).alias("wt"), zero.alias("wd"))
    backward = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), zero.alias("wt"), (F.col("n") / F.col("of")).alias("wd"))
    steps = checkpointed(forward.union(backward))
    mass = start.select("host", F.col("bt").alias("trust"), F.col("bd").alias("distrust"))
    if rounds is None:
        seeded, last = start.agg(F.sum(F.col("bt") + F.col("bd"))).first()[0] or 0.0, checkpointed(mass)
    k = 0
    while rounds is None or k < rounds:
        moved = mass.join(steps, mass.host == steps.src).groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("trust") * F.col("wt"))).alias("mt"), (damping * F.sum(F.col("distrust") * F.col("wd"))).alias("md"))
        mass = start.join(moved, "host", "full").select("host", (F.coalesce("bt", zero) + F.coalesce("mt", zero)).alias("trust"), (F.coalesce("bd", zero) + F.coalesce("md", zero)).alias("distrust"))
        k += 1
        if k % EVERY and k != rounds:
            continue
        mass = checkpointed(mass)
        if rounds is None:
            was = last.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
            both = mass.join(was, "host", "full")
            change = both.agg(F.sum(F.abs(F.coalesce("trust", zero) - F.coalesce("t", zero)) + F.abs(F.coalesce("distrust", zero) - F.coalesce("d", zero)))).first()[0] or 0.0
            if change <= tolerance * seeded:
                break
            last = mass
    return mass


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """pages without html, with host, path, rule and verdict."""
    judged = ruled(pages.drop("html"), rules)
    mass = host_mass(judged, host_edges(pages), rounds=None)
    bad = checkpointed(mass.where(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))).select(F.col("host").alias("_bad")))
    side = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    out = judged.join(side, judged["host"] == side["_bad"], "left")
    verdict = F.coalesce(judged["verdict"], F.when(side["_bad"].isNotNull(), "block").otherwise("allow")).alias("verdict")
    return out.select(*[verdict if c == "verdict" else judged[f"`{c}`"] for c in judged.columns])


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    low = "translate({}, '" + UPPER + "', '" + LOWER + "')"
    ranked = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fit = " ".join(f"WHEN (host = '{r[: r.index('/')]}' OR ends_with(host, '.{r[: r.index('/')]}')) AND starts_with(path, '{r[r.index('/') :]}') THEN '{r}'" for _, r in ranked)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in ranked)
    link = LINK.replace("'", "''")
    sql = f"""WITH cut AS (SELECT page_id, {low.format(f"coalesce(regexp_extract(url, '{URL}', 1), '')")} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path, html FROM pages),
judged AS (SELECT page_id, host, path, html, CASE {fit} END AS rule FROM cut),
seeds AS (SELECT host, {1 - DAMPING} * count(*) FILTER (CASE rule {verdict} END = 'allow') AS bt, {1 - DAMPING} * count(*) FILTER (CASE rule {verdict} END = 'block') AS bd FROM judged WHERE host <> '' AND rule IS NOT NULL GROUP BY host),
links AS (SELECT host AS src, {low.format("unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '" + link + "', 1)))")} AS dst FROM judged),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND src <> dst GROUP BY src, dst),
steps AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS wt, 0.0 AS wd FROM edges UNION ALL SELECT dst, src, 0.0, n / sum(n) OVER (PARTITION BY dst) FROM edges),
m0 AS (SELECT host, bt AS trust, bd AS distrust FROM seeds)"""
    for k in range(ROUNDS):
        sql += f""",
m{k + 1} AS (SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
  SELECT host, bt AS trust, bd AS distrust FROM seeds UNION ALL
  SELECT dst, {DAMPING} * trust * wt, {DAMPING} * distrust * wd FROM m{k} JOIN steps ON host = src) GROUP BY host)"""
    return sql + f"""
SELECT page_id, j.host, path, rule, coalesce(CASE rule {verdict} END, CASE WHEN distrust > {THRESHOLD} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN m{ROUNDS} m ON j.host = m.host"""


ORACLE_SQL = _oracle()
