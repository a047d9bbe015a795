"""A training corpus from raw documents: quality, toxicity, near-duplicates, decontamination, tokens.

Counted as a part of the subpackage veritab.llm.

Defined results of all stages. Rows are judged one by one: a row that repeats, has no doc_id or has
extra columns is kept or dropped by its own text, and what is kept keeps its columns, whatever they
are called. A null text is an empty one. Long texts are read whole. An empty table stays empty. Where
labels or the benchmark hold nothing, the stages that learn or look up keep what they cannot judge.

- quality: rows are kept if score >= 0.3. A text without lines has the score of its features alone;
  a doc_id that is labelled several times teaches its greatest label. Without any label, rows are kept.
- toxicity: rows are kept if score < 0.5. Without any label, rows are kept.
- near-dedup: rows meet by SimHash, as in op9_simhash, and by MinHash, and each link is verified on whole
  texts; of the rows that links of similarity 0.8 or more connect, the one with the smallest
  doc_id stays (a null doc_id is the greatest; of equal ones the least hash of the text). Texts
  without words are copies of each other.
- decontamination: rows that hold a window of ten consecutive words of an item, or a whole shorter
  item, are dropped.
- bpe: rows get n_tokens, ids, ids_sha256 and decoded_sha256 in place of their text; columns of those
  names are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import bpe, decontaminate, neardup, quality, toxicity
from veritab.llm.common import table, written


def _unused(name: str, docs: DataFrame) -> str:
    """A name that no column of docs has."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labelled ones, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = _unused("_quality", docs)
    return quality.scored(docs, model, score=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sparse regression, fitted on the labelled ones, does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = _unused("_toxicity", docs)
    return toxicity.scored(docs, model, score=score).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: similarity of five-word shingles 0.8 or more."""
    return neardup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but the text, with the ids of the whole text and the digests of both ways."""
    return bpe.tokenized(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near-dedup", near_deduplicated),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]

#: Trained stages can't be stated in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
