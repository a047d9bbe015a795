"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

Every benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one
window). The words of a window are ordered by their number in the documents; as an occurrence
needs every word of the window, the rarest one is a sufficient prefix. Document words are joined
with these prefix words; position and length bounds follow, and then the exact comparison of the
window with the words around the prefix word.

Defined results. Null texts have no words. Items with a null id or no words take no part; an
item_id that repeats stands for all its texts. Document rows are judged one by one, even if a
doc_id repeats or is null; other columns pass through, but for those called like an output, in any case. An
empty benchmark hits nothing, an empty table gives an empty one. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOTS, carried, checkpointed, table

WINDOW = 10
#: A side of a join is broadcast only if its words have this many bytes at most (counted first).
BROADCAST_BYTES = 16 << 20
#: Places of an anchor beyond which they are dealt over salts.
HOT_ROWS = 100_000
#: What stands between words, in any text and in one without A-Z, and the two alphabets.
#: (Splitting there is several times faster than extracting runs of all other characters.)
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(w: Column) -> Column:
    """w with A-Z lower-cased and nothing else changed."""
    return F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), GAP), "")


def _sized(df: DataFrame, size: Column) -> tuple[DataFrame, bool]:
    """df, with a broadcast hint if it is small; whether it is."""
    small = (df.agg(F.sum(size + 100)).first()[0] or 0) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), small


def windows_of(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(wid, words, len) of each distinct window, and (wid, item_id)."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") <= window, F.array("w")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))), lambda i: F.slice("w", i, window)))
    of_items = checkpointed(items.select("item_id", F.explode(cut).alias("words")).distinct())
    distinct = checkpointed(of_items.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("len")))
    return distinct, checkpointed(of_items.join(distinct, "words").select("wid", "item_id"))


def anchors_of(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(token, at, n, wid, words, len): the rarest word of each window in the documents, its place, and how often it occurs."""
    vocabulary = checkpointed(windows.select(F.explode("words").alias("token")).distinct())
    known, _ = _sized(vocabulary, F.octet_length("token"))
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("token"))
    counts = tokens.join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    counts = checkpointed(vocabulary.join(counts, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n")))
    places = windows.select("wid", F.posexplode("words").alias("at", "token")).join(counts, "token")
    rarest = places.groupBy("wid").agg(F.min_by(F.struct("token", "at", "n"), F.struct("n", "token", "at")).alias("a"))
    return checkpointed(rarest.select("wid", "a.token", "a.at", "a.n").join(windows, "wid"))


def occurrences(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """(doc_id, h, start, len, wid): every place where a window occurs in a row of docs; start counts from 0."""
    side, small = _sized(anchors.drop("n"), F.octet_length("token") + F.aggregate("words", F.lit(0), lambda a, w: a + F.octet_length(w) + 8))
    listed = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("all"))
    placed = listed.select("doc_id", "h", "all", F.posexplode("all").alias("p", "token"))
    if small:  # one stage of generated code: "all" is never copied
        near = placed.select("doc_id", "h", "p", "token", F.col("all").alias("near"), F.lit(0).alias("skip"))
        met = near.join(side, "token")
    else:  # the rows are shuffled: each takes only the words that a window can reach
        skip = F.greatest(F.col("p") - (reach - 1), F.lit(0))
        near = placed.select("doc_id", "h", "p", "token", F.slice("all", skip + 1, 2 * reach - 1).alias("near"), skip.alias("skip"))
        # Places of frequent anchors are dealt over salts, for which the anchors' windows are repeated.
        most = anchors.select("token", "n").distinct().agg(F.sum("n")).first()[0] or 0
        salts = F.ceil(F.col("n") / F.lit(max(HOT_ROWS, most // HOTS))).cast("int")
        hot = checkpointed(anchors.select("token", salts.alias("salts")).distinct().where("salts > 1"))  # HOTS tokens at most
        near = near.join(F.broadcast(hot), "token", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "p"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        side = side.join(F.broadcast(hot), "token", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
        met = near.join(side, ["token", "salt"])
    start = F.col("p") - F.col("at")
    met = met.where((start >= 0) & (start - F.col("skip") + F.col("len") <= F.size("near")))
    same = F.slice("near", F.greatest(start - F.col("skip") + 1, F.lit(1)), F.col("len")) == F.col("words")
    return met.where(same).select("doc_id", "h", start.alias("start"), "len", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_hit, items) of each row of docs that holds a window; h is xxhash64 of its text."""
    windows, of_items = windows_of(benchmark, window)
    found = checkpointed(occurrences(docs, anchors_of(docs, windows), window).distinct())
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "len"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["len"]).alias("end"), (a["n"] + F.greatest(x["start"] + x["len"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n")),
    )["n"]
    hit = found.groupBy("doc_id", "h").agg(covered.alias("n_hit"))
    pairs = found.select("doc_id", "h", "wid").distinct().join(of_items, "wid").select("doc_id", "h", F.col("item_id").cast("string").alias("item")).distinct()
    items = pairs.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("items")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "items")
    return hit.join(items, hit.doc_id.eqNullSafe(items.d) & (hit.h == items.g)).select("doc_id", "h", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of docs (its text left out) with n_words, n_hit, items and contaminated."""
    found = contamination(docs, benchmark, window).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "items")
    row, columns = carried(docs, "text", "n_words", "n_hit", "items", "contaminated")
    rows = docs.select(row, "doc_id", F.xxhash64("text").alias("h"), F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), RAW_GAP), "")).cast("long").alias("n_words"))
    out = rows.join(found, rows.doc_id.eqNullSafe(found.d) & (rows.h == found.g), "left")
    return out.select(*columns, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that hold no window of the benchmark, with docs' columns."""
    found = contamination(docs, benchmark, window).select(F.col("doc_id").alias("_veritab_d"), F.col("h").alias("_veritab_g"))
    found, _ = _sized(checkpointed(found), F.lit(0))
    return docs.join(found, docs.doc_id.eqNullSafe(found._veritab_d) & (F.xxhash64(docs.text) == found._veritab_g), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
found AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN windows x ON g.k = x.k AND g.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
