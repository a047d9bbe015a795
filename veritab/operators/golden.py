"""Findings held against a manifest of planted items: what was found, at which severity, and how sure.

An item names a concept, a scope or none, and a text that must stand in what a finding says. A finding
says its title, its description and its occurrences, with spaces between. Texts are found by a trigram
index: of the trigrams of an item's text the one in fewest findings of its concept is looked up, and
only findings that hold it are read. Texts shorter than three characters meet all findings of their
concept. What a hot concept or trigram holds is dealt over salts.

Defined results. Items of an unknown or null kind, and true negatives without a check or a number, are
not judged (met is null). A null or empty text, and a null scope, fit any finding; a null concept fits
none. Items with equal ids are judged one by one, in as many rows. Without findings, findings and
decoys are not met; without items there are no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.operators import relational
from veritab.operators.score import REVIEW_THRESHOLD

GRAM = 3
#: The least length of what a finding says of its context, and of the action that it suggests.
CONTEXT_LENGTH, ACTION_LENGTH = 40, 20
#: No finding suggests that a document be changed without a person.
UNASKED = r"(?i)\bauto-?(fix|correct|resolve|update)\b"


def said(findings: DataFrame) -> Column:
    """All that a finding says."""
    each = F.transform("occurrences", lambda o: F.concat_ws(" ", o["value"], o["rawText"], o["citation"]["snippet"]))
    return F.concat_ws(" ", "title", "description", F.array_join(each, " "))


def grams(text: Column) -> Column:
    """The distinct trigrams of a text, in time linear in its length."""
    chars = F.split(text, "")
    size = F.char_length(text)
    places = F.when(size >= GRAM, F.sequence(F.lit(0), size - GRAM)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(places, lambda i: F.concat(*[F.get(chars, i + k) for k in range(GRAM)]))
    return F.array_distinct(cut)


def matches(findings: DataFrame, items: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(item, id, *kept): findings that fit the items (item, conceptKey, scope, evidence). findings: id, conceptKey, scope, said, and what is kept of them."""
    # A finding's trigrams cost by the row, and tables of findings may be small files.
    own = relational.cut(relational.dealt(findings.select("id", "conceptKey", "scope", *kept, "said")).withColumnRenamed("scope", "_scope"))
    wanted = relational.cut(items.select("item", "conceptKey", "scope", F.coalesce("evidence", F.lit("")).alias("evidence")).where("conceptKey IS NOT NULL"))
    key = F.struct("conceptKey", "gram")
    asked = relational.cut(wanted.select("item", "conceptKey", F.explode(grams(F.col("evidence"))).alias("gram")).withColumn("key", key))
    named = asked.select("conceptKey", "gram").distinct()
    sought = named.groupBy("conceptKey").agg(F.collect_set("gram").alias("grams"))  # what a concept's items name
    held = relational.looked_up(own, sought, "conceptKey").select("id", "conceptKey", F.explode(F.array_intersect(grams(F.col("said")), F.col("grams"))).alias("gram"))
    postings = relational.cut(held.select("id", key.alias("key")))
    found = relational.cut(postings.groupBy("key").agg(F.count("*").alias("n")))
    # A trigram that no finding of the concept holds is the rarest: such an item fits none.
    rarest = relational.looked_up(asked, found, "key", "left").groupBy("item").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("key"))
    by_gram = relational.met_by(relational.cut(rarest), postings, "key").select("item", "id")
    fits = (F.col("scope").isNull() | (F.col("scope") == F.col("_scope"))) & F.contains("said", "evidence")
    # Short texts are sought where their concept's findings are; only what fits goes on.
    short = wanted.where(F.char_length("evidence") < GRAM)
    by_concept = relational.met_by(short, own, "conceptKey").where(fits).select("item", "id", *kept)
    read = relational.looked_up(relational.cut(by_gram), wanted.drop("conceptKey"), "item")
    read = relational.looked_up(relational.cut(read), own.drop("conceptKey"), "id")
    return read.where(fits).select("item", "id", *kept).unionByName(by_concept)


def outcomes(findings: DataFrame, manifest: DataFrame, checks: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """A row for each item of manifest: (item, id, kind, conceptKey, found, confidence, met).

    FINDING: met if findings fit, one of them at the item's severity, the surest at or above the review
    threshold, and each of them cited, with a context and an action for a person. DECOY: met if findings
    fit and the least sure is below the threshold, MINOR, and says why. TRUE_NEGATIVE: met if
    recomputations of that label exist and all are confirmed, or if at least so many references resolve and
    none of them is in a finding. confidence is that of the surest finding (for decoys of the least sure).
    """
    items = relational.dense_numbers(manifest, ["id", "kind", "conceptKey", "evidence", "scope", "severity", "arithmetic", "resolvedCrossReferences", F.xxhash64(*manifest.columns)], "item")
    items = relational.cut(items)
    planted = items.where("kind IN ('FINDING', 'DECOY')")
    stands = (F.size("occurrences") > 0) & (F.char_length(F.coalesce("regulatoryContext", F.lit(""))) > CONTEXT_LENGTH) & (F.char_length(F.coalesce("suggestedAction", F.lit(""))) > ACTION_LENGTH) & ~F.coalesce("suggestedAction", F.lit("")).rlike(UNASKED)
    facts = findings.select("id", "conceptKey", "scope", F.col("severity").alias("_severity"), "confidence", stands.alias("stands"), (F.coalesce("benignNote", F.lit("")) != "").alias("noted"), said(findings).alias("said"))
    met = matches(facts, planted, ["_severity", "confidence", "stands", "noted"])
    least = F.struct("confidence", F.length("id").alias("length"), "id")
    # Sums by item and severity are few; what the item asks for meets them, not the findings.
    graded = met.groupBy("item", "_severity").agg(F.count("*").alias("found"), F.max("confidence").alias("most"), F.bool_and("stands").alias("stands"), F.min("confidence").alias("least"), F.min(least).alias("_least"), F.min_by("noted", least).alias("noted"))
    graded = graded.join(planted.select("item", "severity"), "item")
    sums = graded.groupBy("item").agg(
        F.sum("found").alias("found"), F.bool_or(F.col("_severity") == F.col("severity")).alias("graded"), F.max("most").alias("most"), F.bool_and("stands").alias("stands"), F.min("least").alias("least"),
        F.min_by(F.struct("_severity", "noted"), "_least").alias("low"))
    out = items.join(sums, "item", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    finding = F.coalesce(F.col("graded") & (F.col("most") >= REVIEW_THRESHOLD) & F.col("stands"), F.lit(False))
    decoy = F.coalesce((F.col("least") < REVIEW_THRESHOLD) & (F.col("low._severity") == "MINOR") & F.col("low.noted"), F.lit(False))
    out = out.withColumn("met", F.when(F.col("kind") == "FINDING", finding).when(F.col("kind") == "DECOY", decoy)).withColumn("confidence", F.when(F.col("kind") == "DECOY", F.col("least")).otherwise(F.col("most")))
    out = out.select("item", "id", "kind", "conceptKey", "arithmetic", "resolvedCrossReferences", "found", "confidence", "met")
    if checks is not None:
        labels = relational.cut(checks.groupBy("label").agg(F.count("*").alias("_n"), F.bool_and(F.col("outcome") == "CONFIRMED").alias("_ok")))
        negatives = items.where("kind = 'TRUE_NEGATIVE' AND arithmetic IS NOT NULL").select("item", F.lit("").alias("conceptKey"), F.lit(None).cast("string").alias("scope"), F.col("arithmetic").alias("evidence"))
        named = labels.where("label IS NOT NULL").select(F.col("label").alias("id"), F.lit("").alias("conceptKey"), F.lit("").alias("scope"), F.col("label").alias("said"))
        held = matches(named, negatives).join(labels, F.col("id") == F.col("label")).groupBy("item").agg(F.sum("_n").alias("_n"), F.bool_and("_ok").alias("_ok"))
        out = out.join(held, "item", "left")
        wanted = (F.col("kind") == "TRUE_NEGATIVE") & F.col("arithmetic").isNotNull()
        out = out.withColumns({"met": F.when(wanted, F.coalesce("_ok", F.lit(False))).otherwise(F.col("met")), "found": F.when(wanted, F.coalesce("_n", F.lit(0))).otherwise(F.col("found"))}).drop("_n", "_ok")
    if entities is not None:
        resolved = relational.cut(entities.where("conceptKey = 'crossref.integrity' AND normalizedValue = 'RESOLVED'").select(F.col("id").alias("entityId")))
        reported = findings.select(F.explode("occurrences").alias("o")).select("o.entityId").distinct()
        counts = resolved.agg(F.count("*").alias("_n")).crossJoin(resolved.join(reported, "entityId", "left_semi").agg(F.count("*").alias("_r")))  # single rows
        wanted = (F.col("kind") == "TRUE_NEGATIVE") & F.col("resolvedCrossReferences").isNotNull()
        out = out.crossJoin(F.broadcast(counts)).withColumns({"met": F.when(wanted, (F.col("_n") >= F.col("resolvedCrossReferences")) & (F.col("_r") == 0)).otherwise(F.col("met")), "found": F.when(wanted, F.col("_n")).otherwise(F.col("found"))}).drop("_n", "_r")
    return out.select("item", "id", "kind", "conceptKey", "found", "confidence", "met")


def recall(judged: DataFrame) -> DataFrame:
    """(kind, items, met, recall) of outcomes() by kind; items that are not judged are left out."""
    counted = judged.where("met IS NOT NULL").groupBy("kind").agg(F.count("*").alias("items"), F.count_if("met").alias("met"))
    return counted.withColumn("recall", F.col("met") / F.col("items"))


def precision(findings: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (sure, planted, precision): findings at or above the review threshold, and those that fit a planted FINDING."""
    items = manifest.where("kind = 'FINDING'").select("conceptKey", "scope", "evidence").distinct()
    items = relational.cut(relational.dense_numbers(items, ["conceptKey", "scope", "evidence"], "item"))
    sure = findings.where(F.col("confidence") >= REVIEW_THRESHOLD)
    fit = matches(sure.withColumn("said", said(sure)), items).select("id").distinct()
    counts = sure.agg(F.count("*").alias("sure")).crossJoin(fit.agg(F.count("*").alias("planted")))  # single rows
    return counts.withColumn("precision", F.try_divide("planted", "sure"))
