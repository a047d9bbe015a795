"""Summaries of findings: matrix of categories and documents, counts by severity and scope, menus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.scalars import shade
from veritab.model import DOCUMENT_TYPES, SEVERITIES, position


def pivot(df: DataFrame, row: str, column: str, values: Sequence, **measures) -> DataFrame:
    """df's measures in a column for each of values, a row for each of row; missing cells are null."""
    return df.groupBy(row).pivot(column, list(values)).agg(*[m.alias(k) for k, m in measures.items()])


def cells(findings: DataFrame) -> DataFrame:
    """(category, documentType, n, worst, open, shade); a finding counts once for each document type."""
    rows = findings.select("category", "disposition", position(F.col("severity"), SEVERITIES).alias("rank"), F.explode(F.array_distinct("documentTypes")).alias("documentType"))
    g = rows.groupBy("category", "documentType").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.count_if(F.col("disposition").isNull()).alias("open"))
    return g.select("category", "documentType", "n", F.get(F.array(*[F.lit(s) for s in SEVERITIES]), "rank").alias("worst"), "open", shade(F.col("n")).alias("shade"))


def matrix(findings: DataFrame) -> DataFrame:
    return pivot(cells(findings), "category", "documentType", DOCUMENT_TYPES, n=F.first("n"), worst=F.first("worst"), open=F.first("open")).orderBy("category")


def by_severity_and_scope(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "scope").agg(F.count("*").alias("n"))


def menus(findings: DataFrame) -> DataFrame:
    """(menu, value): categories and document types to filter by."""
    return findings.select(F.lit("category").alias("menu"), F.col("category").alias("value")).union(findings.select(F.lit("document"), F.explode("documentTypes"))).distinct()


def run_summary(findings: DataFrame, checks: DataFrame) -> DataFrame:
    f = findings.agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])
    return f.crossJoin(checks.agg(F.count("*").alias("checks"), F.count_if(F.col("outcome") == "CONFIRMED").alias("confirmed")))  # single rows
