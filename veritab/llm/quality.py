"""Quality: a linear-chain conditional random field labels every line good or bad.

Each line is described by figures of its own and of the lines before and after it. The
forward-backward marginals of its lines, weighted by their lengths, make a text's quality;
a one-dimensional logistic map, fitted with the field, turns it into a probability.

Defined results. Lines end at "\n"; lines without any byte take no part. A null, empty or
newline-only text has quality 0.5, mapped like any other (one constant). Null labels and
labels of unknown ids teach nothing; a doc_id labelled several times counts with its largest
label. Repeated rows are scored each. Without usable labels all scores are one constant. Very
long texts are read whole. Extra columns pass through; an input column called like an output
is replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesarr as B
from .common import bounded_batches, fold
from .toxicity import learning_rows

#: Labelled rows that the field is fitted on, at most.
FIT_ROWS = 6000
STEPS, RATE, RIDGE = 150, 0.08, 1e-3
THRESHOLD = 0.3

#: Classes of bytes, each a figure of a line (its share of the line's bytes).
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 32), "stop": b".?", "comma": b",;:", "bang": b"!",
    "bar": b"|", "mark": b"#$%&*@^~", "bracket": b"()[]{}<>", "quote": b"'\"`", "slash": b"/\\_=+", "dash": b"-", "high": range(128, 256),
}
_CLASS = np.full(256, len(CLASSES), dtype=np.int64)
for _k, _v in enumerate(CLASSES.values()):
    _CLASS[list(_v)] = _k
_FILLED = np.ones(256, dtype=bool)
_FILLED[[9, 10, 11, 12, 13, 32]] = False
_SAME = np.arange(256, dtype=np.uint8)
OWN = len(CLASSES) + 7


def line_figures(buf: np.ndarray, cuts: np.ndarray):
    """Figures of each line that has bytes, its length, and the text it is of."""
    breaks = np.flatnonzero(buf == 10)
    begin = np.union1d(np.append(breaks + 1, 0), cuts[:-1])
    begin = begin[begin < len(buf)]
    end = np.append(begin[1:], len(buf))[: len(begin)]  # texts without bytes have no line
    end = end - (buf[end - 1] == 10)
    begin, end = begin[end > begin], end[end > begin]
    n = len(begin)
    length = (end - begin).astype(np.float64)
    out = np.zeros((n, OWN))
    if not n:
        return out, length, np.zeros(0, np.int64)
    for k in range(len(CLASSES)):
        total = np.concatenate([[0], np.cumsum(_CLASS[buf] == k)])
        out[:, k] = (total[end] - total[begin]) / length
    starts, lengths, hashes = B.word_hashes(buf, np.union1d(begin, cuts), _FILLED, _SAME)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    words = np.maximum(b - a, 1)
    line = np.repeat(np.arange(n), b - a)
    c = len(CLASSES)
    order = np.lexsort((hashes, line)) if len(line) else np.zeros(0, np.int64)
    fresh = np.ones(len(line), dtype=bool)
    fresh[1:] = (line[order][1:] != line[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    out[:, c] = np.bincount(line[order][fresh], minlength=n) / words
    same = np.zeros(len(line))
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    out[:, c + 1] = np.bincount(line, same, n) / words
    out[:, c + 2] = np.bincount(line, lengths, n) / words / 10
    out[:, c + 3] = np.log1p(length) / 8
    out[:, c + 4] = np.log1p(words) / 6
    last = buf[end - 1]
    out[:, c + 5] = np.isin(last, np.frombuffer(b".?", np.uint8))
    tail = buf[np.minimum(starts + lengths - 1, len(buf) - 1)] if len(starts) else np.zeros(0, np.uint8)
    out[:, c + 6] = np.bincount(line, np.isin(_CLASS[tail], [6, 8]), n) / words
    return out, length, np.searchsorted(cuts, begin, side="right") - 1


def with_neighbours(own: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """A line's figures, those of the lines before and after (0 at a text's ends), which ends it is at, and 1."""
    n, k = own.shape
    out = np.zeros((n, 3 * k + 3))
    out[:, :k], out[:, -1] = own, 1
    if n:
        joined = text_of[1:] == text_of[:-1]
        out[1:, k : 2 * k][joined] = own[:-1][joined]
        out[:-1, 2 * k : 3 * k][joined] = own[1:][joined]
        out[:, -3] = np.concatenate([[True], ~joined])
        out[:, -2] = np.concatenate([~joined, [True]])
    return out


def marginals(emit: np.ndarray, move: np.ndarray, text_of: np.ndarray):
    """Forward-backward over all chains at once: P(good) of each line, P of each pair of states, log Z summed.

    emit: score of good over bad for each line; move: 2 x 2 scores of going from state to state.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    first = np.flatnonzero(np.concatenate([[True], text_of[1:] != text_of[:-1]]))
    sizes = np.diff(np.append(first, n))
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    e = np.zeros((n, 2))
    e[:, 1] = emit
    alpha, beta, pairs = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((2, 2))
    alpha[first] = e[first]
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # chains with more than t lines
    for t in range(1, sizes[0]):
        at = first[: active[t]] + t
        alpha[at] = np.logaddexp(alpha[at - 1, :1] + move[0], alpha[at - 1, 1:] + move[1]) + e[at]
    ends = first + sizes - 1
    log_z = np.zeros(n)
    for t in range(sizes[0] - 1, 0, -1):
        at = first[: active[t]] + t
        onward = beta[at] + e[at]
        beta[at - 1] = np.logaddexp(move[:, 0] + onward[:, :1], move[:, 1] + onward[:, 1:])
    z = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    log_z = np.repeat(z[np.argsort(order)], sizes[np.argsort(order)])
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - log_z, -60, 0))
    inner = np.flatnonzero(text_of[1:] == text_of[:-1])
    for i in range(2):
        for j in range(2):
            pairs[i, j] = np.exp(np.clip(alpha[inner, i] + move[i, j] + e[inner + 1, j] + beta[inner + 1, j] - log_z[inner], -60, 0)).sum()
    return good, pairs, float(z.sum())


def _adam(x: np.ndarray, text_of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition scores of greatest penalised conditional likelihood."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    n = max(1, len(y))
    inner = text_of[1:] == text_of[:-1]
    seen = np.array([[((y[:-1] == i) & (y[1:] == j) & inner).sum() for j in range(2)] for i in range(2)], dtype=float)
    theta = np.concatenate([w, move.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        good, pairs, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), text_of)
        g = np.concatenate([x.T @ (good - y), (pairs - seen).ravel()]) / n + RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def whole(good: np.ndarray, length: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """Length-weighted mean of the lines' marginals for each text."""
    bytes_of = np.bincount(text_of, length, n)
    return np.where(bytes_of > 0, np.bincount(text_of, length * good, n) / np.maximum(bytes_of, 1), 0.5)


def fit(own: np.ndarray, length: np.ndarray, text_of: np.ndarray, y: np.ndarray) -> dict:
    """The field, and the map from a text's quality to its probability.

    Lines take their text's label at first; then those lines of bad texts that the field
    holds for good are called good, and the field is fitted again.
    """
    if not len(own) or not len(y):
        return {"mean": [0.0] * OWN, "sd": [1.0] * OWN, "w": [0.0] * (3 * OWN + 3), "move": [0.0] * 4, "a": 0.0, "b": 0.0}
    mean, sd = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours((own - mean) / sd, text_of)
    line_y = y[text_of].astype(float)
    w, move = _adam(x, text_of, line_y)
    good, _, _ = marginals(x @ w, move, text_of)
    refined = np.where((line_y == 0) & (good > 0.5), 1.0, line_y)
    if (refined == 0).sum() > 0.5 * (line_y == 0).sum():
        w, move = _adam(x, text_of, refined)
        good, _, _ = marginals(x @ w, move, text_of)
    q = whole(good, length, text_of, len(y))
    u = np.log((q + 1e-3) / (1 - q + 1e-3))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, each slightly damped
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -35, 35)))
        s = p * (1 - p)
        hess = np.array([[(s * u * u).sum() + 1.0, (s * u).sum()], [(s * u).sum(), s.sum() + 1.0]])
        step = np.linalg.solve(hess, np.array([((y - p) * u).sum() - (a - 1), (y - p).sum() - b]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean.tolist(), "sd": sd.tolist(), "w": w.tolist(), "move": move.ravel().tolist(), "a": float(a), "b": float(b)}


def predict(model: dict, buf: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each text."""
    own, length, text_of = line_figures(buf, cuts)
    x = with_neighbours((own - np.array(model["mean"])) / np.array(model["sd"]), text_of)
    good, _, _ = marginals(x @ np.array(model["w"]), np.array(model["move"]).reshape(2, 2), text_of)
    q = whole(good, length, text_of, len(cuts) - 1)
    return 1 / (1 + np.exp(-np.clip(model["a"] * np.log((q + 1e-3) / (1 - q + 1e-3)) + model["b"], -35, 35)))


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict:
    """The model, fitted in one task on a bounded sample of labelled rows."""

    def fitted(batches):
        owns, lengths, texts, ys, n = [np.zeros((0, OWN))], [np.zeros(0)], [np.zeros(0, np.int64)], [], 0
        for b in batches:
            buf, offsets = B.buffers(b.column("text"))
            for i, j in B.groups_of_texts(offsets, B.STEP):
                own, length, text_of = line_figures(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                owns.append(own)
                lengths.append(length)
                texts.append(text_of + n)
                n += j - i
            ys += b.column("y").to_pylist()
        model = fit(np.concatenate(owns), np.concatenate(lengths), np.concatenate(texts), np.array(ys, dtype=float))
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in model.items()})

    rows = learning_rows(docs, labels, "quality", most)
    out = rows.coalesce(1).mapInArrow(fitted, "mean array<double>, sd array<double>, w array<double>, move array<double>, a double, b double")
    got = out.collect()
    return got[0].asDict() if got else next(fitted([])).to_pylist()[0]  # an empty table may have no task


def scored(docs: DataFrame, model: dict, text: str = "text", score: str = "score") -> DataFrame:
    """docs with the probability of quality of each whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few hundred numbers
    schema = T.StructType([f for f in docs.schema.fields if f.name != score] + [T.StructField(score, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for b in batches:
            buf, offsets = B.buffers(b.column(text))
            p = [predict(shared.value, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in B.groups_of_texts(offsets, B.STEP)]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(np.concatenate([np.zeros(0), *p]), pa.float64())], names=[*names, score])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """Every row of docs with held_out, score and predicted."""
    model = train(docs, labels, most)
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")]
    out = scored(docs.select(*keep), model)
    return out.withColumns({"held_out": F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})


def op2_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "held_out", "score", "predicted")
