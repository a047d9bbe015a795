"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 make the weights sparse; only weights other than zero
are broadcast (at most 2**BITS of them, whatever the corpus). A feature counts once a text.

Defined results. A null or empty text has no feature and gets the bias alone. Labels that are
null, or of unknown ids, teach nothing; a doc_id labelled several times counts with its largest
label. Repeated rows are scored each. With no usable label at all, every score is one constant.
Very long texts are read whole, in steps. Extra columns pass through; a column of the input
called like one of the outputs is replaced by the output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesarr as B
from .common import bounded_batches, fold

BITS = 22
#: Labelled rows that the classifier is fitted on, at most; those with the smallest hashes are taken.
FIT_ROWS = 16_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
THRESHOLD = 0.5


def features(hashes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, pairs of neighbours and pairs one word apart, each with its text."""
    with np.errstate(over="ignore"):
        pair = B.mix(hashes[:-1] * np.uint64(3) + (hashes[1:] ^ np.uint64(0x51ED270B)))
        skip = B.mix(hashes[:-2] * np.uint64(7) + (hashes[2:] ^ np.uint64(0x2545F491)))
    shift = np.uint64(64 - BITS)
    in_pair, in_skip = text_of[:-1] == text_of[1:], text_of[:-2] == text_of[2:]
    return (
        np.concatenate([hashes >> shift, pair[in_pair] >> shift, skip[in_skip] >> shift]).astype(np.int64),
        np.concatenate([text_of, text_of[:-1][in_pair], text_of[:-2][in_skip]]),
    )


def _featured(texts: pa.Array):
    """For groups of texts: first text, texts, features, the text of each."""
    buf, offsets = B.buffers(texts)
    for i, j in B.groups_of_texts(offsets, B.STEP):
        part, cuts = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, _, hashes = B.word_hashes(part, cuts)
        text_of = np.searchsorted(cuts, starts, side="right") - 1
        f, t = features(hashes, text_of)
        yield i, j, f, t


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, indices and weights of the FTRL-proximal model."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.25
    bias0 = float(np.log(rate / (1 - rate)))
    bias, bias_n = bias0, 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f = rows[k]
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - labels[k]
            sigma = (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA
            z[f] = zf + g - sigma * w
            n[f] = nf + g * g
            bias_n += g * g
            bias -= 0.05 * g / np.sqrt(bias_n)
    kept = np.flatnonzero(np.abs(z) > L1)
    weights = -(z[kept] - np.sign(z[kept]) * L1) / ((BETA + np.sqrt(n[kept])) / ALPHA + L2)
    return float(bias), kept, weights


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5) -> DataFrame:
    """(text, y) of at most most labelled documents outside the held-out fold, by smallest hash."""
    bounded_batches(docs.sparkSession)
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    own = own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # labels of other documents take no places
    own = own.where(fold(F.col("doc_id"), folds) != 0).withColumn("_h", F.xxhash64(F.lit("fit"), F.col("doc_id").cast("string")))
    chosen = own.orderBy("_h", "doc_id").limit(most)  # ids only; at most `most` of them, so a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.orderBy("_h", F.xxhash64("text")).limit(most).select("text", F.col("y").cast("double").alias("y"), "_h")


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[float, np.ndarray, np.ndarray]:
    """The model, fitted in one task on a bounded sample of labelled rows."""
    rows = learning_rows(docs, labels, "toxic", most)

    def fitted(batches):
        xs, ys, hs = [], [], []
        for b in batches:
            for i, j, f, t in _featured(b.column("text")):
                order = np.argsort(t, kind="stable")
                f, bounds = f[order], np.searchsorted(t[order], np.arange(j - i + 1))
                xs += [np.unique(f[bounds[k] : bounds[k + 1]]).astype(np.int32) for k in range(j - i)]
            ys += b.column("y").to_pylist()
            hs += b.column("_h").to_pylist()
        order = np.lexsort((np.array([len(x) for x in xs]), np.array(hs, dtype=np.int64))) if xs else []
        bias, at, w = fit([xs[k] for k in order], np.array([ys[k] for k in order]))
        yield pa.RecordBatch.from_pydict({"bias": [bias], "at": [at], "w": [w]})

    model = rows.coalesce(1).mapInArrow(fitted, "bias double, at array<long>, w array<double>").collect()
    model = model[0] if model else next(fitted([])).to_pylist()[0]  # an empty table may have no task
    return model["bias"], np.array(model["at"], dtype=np.int64), np.array(model["w"], dtype=np.float64)


def scored(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray], text: str = "text", score: str = "score") -> DataFrame:
    """docs with the model's score of each whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # sparse weights: 2**BITS at most
    schema = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        bias, at, w = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for b in batches:
            total = np.full(b.num_rows, bias)
            for i, j, f, t in _featured(b.column(text)):
                hit = dense[f] != 0
                once = np.unique((t[hit].astype(np.int64) << BITS) | f[hit])
                total[i:j] += np.bincount(once >> BITS, dense[once & ((1 << BITS) - 1)], j - i)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(p, pa.float64())], names=[*names, score])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Every row of docs with held_out, score and predicted."""
    model = train(docs, labels, most)
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = scored(docs.select(*keep), model)
    return out.withColumns({"held_out": F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")
