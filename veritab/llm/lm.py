"""Language-model scores by a class-based bigram model over all training texts.

Counts cover every training token, and every training word gets a class by exchange clustering.
It starts from the SEEDS most frequent words, which are exchanged one at a time over their whole
table of pairs (all other words are one more symbol there), until nothing moves or SEED_ROUNDS have
passed. Then ROUNDS rounds go over all other words of the vocabulary: each word's neighbours are
counted by class in all training texts, and the word moves to the class that these counts make
likeliest, given the table of class pairs and the classes' sizes with the word in them. Words of a
round move at once; a round that does not raise the likelihood of the training text is taken back
and ends the clustering. Words are spread over buckets (see blocks.py); a task holds the profiles
of one bucket's words, and only tables of classes reach the driver.

P(word | previous) = P(class | class of previous) * P(word | class). Transitions are smoothed by
class frequencies; each class keeps mass for unknown words, by its share of words seen once. An
unknown word has no class: its probability is summed over all classes, and what follows it is
predicted from classes in proportion to their mass for unknown words.

Defined results. A null text is empty: one token, the end. A null doc_id is trained on. Repeated
rows count and are scored each. With nothing to train on, N = V = 0: base_score is 0 and score
comes from even classes. Of equally frequent words the lesser in byte order is the seed. Long
texts are read whole. Other columns of docs pass through scored(), but for those called like an
output. An empty table gives an empty one.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .common import bounded_batches, carried, fold, table, written

#: Words that are clustered first; classes; rounds over these words, and over all others.
SEEDS, CLASSES, SEED_ROUNDS, ROUNDS = 1000, 48, 8, 2
#: Weight of class frequencies in transitions.
ALPHA = 5.0
ANSWER = "block long, bucket long, blob binary"
_ROWS = 1 << 14


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only; white space is \x20 \x09-\x0D


def _split(texts: pa.Array):
    for x in texts:
        yield words_of(x.as_buffer().to_pybytes()) if x.is_valid else []


def _number(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's vocabulary (block 0: words and training counts), and for each block the numbers and counts of the words it asked for."""
    asks, total = [], {}
    for blob in rows["blob"]:
        lengths, data, tally = blocks.unpack(blob, None, None, np.int64)
        words = blocks.unpack_words(lengths, data)
        asks.append(words)
        for w, n in zip(words, tally.tolist(), strict=True):
            total[w] = total.get(w, 0) + n
    listed = sorted(total)
    number = {w: i for i, w in enumerate(listed)}
    count = np.fromiter(map(total.__getitem__, listed), np.int64, len(listed))
    slots, counts = [blocks.pack(*blocks.pack_words(listed))], [blocks.pack(np.zeros(1, np.uint8), blocks.planes(count, 8))]
    for words in asks:
        own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        slots.append(blocks.pack(blocks.planes(own)))
        counts.append(blocks.pack(np.zeros(1, np.uint8), blocks.planes(count[own], 8)))
    bucket = rows["bucket"].iloc[0]
    return pd.DataFrame({"block": [0, *rows["block"]], "bucket": [bucket] * (len(asks) + 1), "slots": slots, "blob": counts})


def _counts(blob: bytes) -> np.ndarray:
    return blocks.from_planes(blocks.unpack(blob, None, None)[1], 8).astype(np.int64)


def _leading(seeds: int):
    """The most frequent words of each bucket, seeds at most, and (number -1) its training tokens and words."""

    def run(batches):
        for b in batches:
            for bucket, words, counts in zip(b.column("bucket").to_pylist(), b.column("slots"), b.column("blob"), strict=True):
                n, listed = _counts(counts.as_py()), blocks.unpack_words(*blocks.unpack(words.as_py(), None, None))
                top = np.lexsort((np.arange(len(n)), -n))[:seeds]  # the vocabulary is in byte order
                top = top[n[top] > 0].tolist()
                yield pa.RecordBatch.from_pydict({"bucket": [bucket] * (len(top) + 1), "number": [*top, -1], "word": [*[listed[k] for k in top], b""], "n": [*n[top].tolist(), int(n.sum())], "words": [*[0] * len(top), int((n > 0).sum())]})

    return run


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = SEED_ROUNDS) -> np.ndarray:
    """Class of each symbol; the last symbol (the end) is alone in the last class."""
    def f(x):
        return x * np.log(np.maximum(x, 1e-300))

    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n - 1) % classes
    of[-1] = classes
    k = classes + 1
    member = np.zeros((n, k))
    member[np.arange(n), of] = 1
    g = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for s in order:
            if not weight[s]:
                continue
            a, d = of[s], pairs[s, s]
            r, l = pairs[s] @ member, pairs[:, s] @ member
            r[a] -= d
            l[a] -= d
            g[a] -= r
            g[:, a] -= l
            g[a, a] -= d
            row, col = g.sum(1), g.sum(0)
            base = f(g)
            by_row, by_col = f(g + r) - base, f(g + l[:, None]) - base
            own = np.diag(g)
            gain = by_row.sum(1) - np.diag(by_row) + by_col.sum(0) - np.diag(by_col) + f(own + r + l + d) - f(own)
            row, col = row + l, col + r  # what others gain wherever the symbol goes
            gain -= f(row + r.sum() + d) - f(row) + f(col + l.sum() + d) - f(col)
            gain[-1] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            g[b] += r
            g[:, b] += l
            g[b, b] += d
            if b != a:
                member[s, a], member[s, b], of[s] = 0, 1, b
                moved += 1
        if not moved:
            break
    return of


def _sequence(kind: np.ndarray, size: np.ndarray, code: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What the tokens of texts are (the end after each text), and which of them are words."""
    last = np.cumsum(size + 1) - 1
    inner = np.ones(len(code) + len(size), dtype=bool)
    inner[last] = False
    seq = np.full(len(inner), end, np.int64)
    seq[inner] = kind[code]
    return seq, inner


def _learned(head: pa.Table, size: np.ndarray) -> np.ndarray:
    """Whether each token, ends too, is of a text that is learned from."""
    return np.repeat(head.column("learn").to_numpy(zero_copy_only=False).astype(bool), size + 1)


def _cells(pairs: np.ndarray) -> pa.Table:
    at = np.flatnonzero(pairs)
    return pa.table({"cell": pa.array(at, pa.int64()), "n": pa.array(pairs[at].astype(np.int64), pa.int64())})


def _seed_symbols(numbered: DataFrame, shared, seeds: int) -> DataFrame:
    """Answers with the symbols of words: a seed's number, or seeds for all other words."""

    def run(batches):
        for b in batches:
            blobs = []
            for bucket, slots in zip(b.column("bucket").to_pylist(), b.column("slots"), strict=True):
                own = blocks.from_planes(blocks.unpack(slots.as_py(), None)[0])
                symbols = np.full(len(own), seeds, np.int16)
                for number, symbol in shared.value.get(bucket, {}).items():
                    symbols[own == number] = symbol
                blobs.append(blocks.pack(symbols))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array(blobs, pa.binary())], names=["block", "bucket", "blob"])

    return numbered.where("block > 0").select("block", "bucket", "slots").mapInArrow(run, ANSWER)


def _seed_pairs(seeds: int):
    n = seeds + 2

    def finish(head: pa.Table, size: np.ndarray, code: np.ndarray, got) -> pa.Table:
        kind = np.full(int(code.max()) + 1 if len(code) else 0, seeds, np.int64)
        for _, place, symbols in got:
            kind[place] = symbols
        seq, _ = _sequence(kind, size, code, n - 1)
        before = np.concatenate([[n - 1], seq[:-1]])
        own = _learned(head, size)
        return _cells(np.bincount(before[own] * n + seq[own], minlength=n * n))

    return finish


def _profiles(whole: bool, end: int):
    """A block's counts of class pairs (bucket -1) and, if whole, of the classes beside each of its words, by bucket."""
    k = end + 1

    def finish(head: pa.Table, size: np.ndarray, code: np.ndarray, got) -> pa.Table:
        kind, places = np.full(int(code.max()) + 1 if len(code) else 0, end + 1, np.int64), []
        for bucket, place, _, classes in got:
            kind[place] = np.frombuffer(classes, np.uint8)
            places.append((bucket, place.start, place.stop))
        seq, inner = _sequence(kind, size, code, end)
        before, after, own = np.concatenate([[end], seq[:-1]]), np.concatenate([seq[1:], [end]]), _learned(head, size)
        pairs = np.bincount(before[own] * k + seq[own], minlength=k * k)
        buckets, blobs = [-1], [blocks.pack(pairs.astype(np.int64))]
        if whole:
            at, words = own & inner, code[own[inner]]
            keys = np.concatenate([words * (2 * k) + before[at], words * (2 * k) + k + after[at]])
            keys = np.sort(keys.astype(np.uint32) if (len(kind) + 1) * 2 * k < 1 << 32 else keys)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            times, keys = np.diff(np.append(first, len(keys))), keys[first].astype(np.int64)
            for bucket, low, high in places:
                s, e = np.searchsorted(keys, [low * 2 * k, high * 2 * k]).tolist()
                cells = np.bincount(keys[s:e] // (2 * k) - low, minlength=high - low)
                buckets.append(bucket)
                blobs.append(blocks.pack(blocks.planes(cells), (keys[s:e] % (2 * k)).astype(np.uint8), blocks.planes(times[s:e])))
        return pa.table({"bucket": pa.array(buckets, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return finish


def _class_pairs(batches):
    total = None
    for b in batches:
        for blob in b.column("blob"):
            own = blocks.unpack(blob.as_py(), np.int64)[0]
            total = own.copy() if total is None else total + own
    if total is not None:
        yield from _cells(total).to_batches()


def _moves(g: np.ndarray) -> np.ndarray:
    """P(class | class), smoothed, from the counts of class pairs."""
    share = (g.sum(0) + 1) / (g.sum() + len(g))
    return (g + ALPHA * share) / (g.sum(1, keepdims=True) + ALPHA)


def likelihood(g: np.ndarray) -> float:
    """What the classes add to the log-likelihood of the training text."""
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return float(f(g) - f(g.sum(0)) - f(g.sum(1)))


def best_classes(left: np.ndarray, right: np.ndarray, own: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The likeliest class of each word, by how often each class precedes and follows it; own: the classes it has."""
    t, size = np.log(_moves(g)), g.sum(0)[:-1]
    n = left.sum(1)[:, None]
    value = left @ t[:, :-1] + right @ t[:-1].T
    value -= n * np.log(np.maximum(size + n * (own[:, None] != np.arange(len(size))), 1))
    return value.argmax(1)


def _moved(g: np.ndarray, seeds):
    """New answers and the new state (block 0) of a bucket's words."""
    k = len(g)

    def run(key, had: pa.Table, seen: pa.Table) -> pa.Table:
        bucket, of_block, state = key[0].as_py(), {}, None
        for block, slots, blob in zip(had.column("block").to_pylist(), had.column("slots"), had.column("blob"), strict=True):
            if block:
                of_block[block] = blocks.from_planes(blocks.unpack(slots.as_py(), None)[0])
            else:
                state = np.frombuffer(blocks.unpack(blob.as_py(), None, None)[1], np.uint8).copy()
        profile = np.zeros((len(state), 2 * k))
        for block, blob in zip(seen.column("block").to_pylist(), seen.column("blob"), strict=True):
            cells, classes, times = blocks.unpack(blob.as_py(), None, np.uint8, None)
            # A block's words are distinct, so no cell stands twice.
            profile[np.repeat(of_block[block], blocks.from_planes(cells)), classes] += blocks.from_planes(times)
        free = profile[:, :k].sum(1) > 0
        free[list(seeds.value.get(bucket, ()))] = False
        free = np.flatnonzero(free)
        for i in range(0, len(free), _ROWS):
            at = free[i : i + _ROWS]
            state[at] = best_classes(profile[at, :k], profile[at, k:], state[at], g)
        return _stated(bucket, of_block, state)

    return run


def _stated(bucket: int, of_block: dict, state: np.ndarray) -> pa.Table:
    one = np.ones(1, np.uint8)
    return pa.table({"block": pa.array([0, *of_block], pa.int64()), "bucket": pa.array([bucket] * (len(of_block) + 1), pa.int64()), "blob": pa.array([blocks.pack(one, state), *[blocks.pack(one, state[x]) for x in of_block.values()]], pa.binary())})


def _first_classes(numbered: DataFrame, seeds, of: np.ndarray) -> DataFrame:
    """Answers and states before the first round: seeds in their classes, other training words in the one of all others."""

    def run(batches):
        for b in batches:
            for block, bucket, slots, counts in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "slots", "blob")), strict=True):
                n = _counts(counts)
                own = np.arange(len(n)) if not block else blocks.from_planes(blocks.unpack(slots, None)[0])
                state = np.where(n > 0, of[-2], of[-1] + 1).astype(np.uint8)
                for number, symbol in seeds.value.get(bucket, {}).items():
                    state[own == number] = of[symbol]
                yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "blob": [blocks.pack(np.ones(1, np.uint8), state)]})

    return numbered.mapInArrow(run, ANSWER)


def _once(batches):
    """(class, words seen once) of each bucket, from rows with its counts and its classes."""
    for b in batches:
        for counts, state in zip(b.column("counts"), b.column("state"), strict=True):
            own = np.frombuffer(blocks.unpack(state.as_py(), None, None)[1], np.uint8)
            found = np.bincount(own[_counts(counts.as_py()) == 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found)), pa.int64()), pa.array(found, pa.int64())], names=["class", "n"])


@dataclass
class Model:
    """Tables of classes, and where the words' counts (numbered) and classes are."""

    numbered: DataFrame
    classes: DataFrame
    pairs: np.ndarray
    once: np.ndarray
    tokens: int
    distinct: int
    texts: int

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of transitions (the unknown word as one more class), sizes, and each class's share for unknown words."""
        g, k = self.pairs, len(self.pairs)
        size = g.sum(0)
        unknown = (self.once + 1) / (size + 2)
        unknown[-1] = 0
        t = np.zeros((k + 1, k + 1))
        t[:k, :k] = _moves(g)
        weight = (size + 1) * unknown
        t[k, :k] = weight / weight.sum() @ t[:k, :k]
        t[:, k] = t[:, :k] @ unknown
        return np.log10(t), size, unknown

    def vocabulary(self) -> DataFrame:
        """(word, n, class) of every training word."""

        def run(batches):
            for b in batches:
                for words, counts, state in zip(*(b.column(c).to_pylist() for c in ("words", "counts", "state")), strict=True):
                    n, own = _counts(counts), np.frombuffer(blocks.unpack(state, None, None)[1], np.uint8)
                    at, listed = np.flatnonzero(n), blocks.unpack_words(*blocks.unpack(words, None, None))
                    yield pa.RecordBatch.from_pydict({"word": pa.array([listed[k] for k in at.tolist()], pa.binary()), "n": pa.array(n[at], pa.int64()), "class": pa.array(own[at], pa.int32())})

        return _states(self.numbered, self.classes).mapInArrow(run, "word binary, n long, class int").withColumn("word", F.col("word").cast("string"))


def _states(numbered: DataFrame, classes: DataFrame) -> DataFrame:
    """(words, counts, state): a row a bucket."""
    held = numbered.where("block = 0").select("bucket", F.col("slots").alias("words"), F.col("blob").alias("counts"))
    return held.join(classes.where("block = 0").select("bucket", F.col("blob").alias("state")), "bucket").select("words", "counts", "state")


def _square(cells: DataFrame, k: int) -> np.ndarray:
    out = np.zeros(k * k)
    for r in cells.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # classes only: k * k cells at most
        out[r["cell"]] = r["n"]
    return out.reshape(k, k)


def model_of(docs: DataFrame, staged: DataFrame, most: int = SEEDS, k: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """The model of k classes, clustered from most seeds in rounds rounds."""
    spark = docs.sparkSession
    numbered = written(blocks.asked(staged).groupBy("bucket").applyInPandas(_number, "block long, bucket long, slots binary, blob binary"), "lm-numbered")
    leading = written(numbered.where("block = 0").mapInArrow(_leading(most), "bucket long, number long, word binary, n long, words long"), "lm-leading")
    seeds = leading.where("number >= 0").orderBy(F.desc("n"), "word").limit(most).select("bucket", "number").collect()
    sums = leading.where("number < 0").agg(F.sum("n").alias("n"), F.sum("words").alias("w")).first()
    texts = docs.where("learn").count()
    tokens, distinct = (sums["n"] or 0) + texts, (sums["w"] or 0) + (texts > 0)
    symbols: dict[int, dict[int, int]] = {}
    for i, r in enumerate(seeds):
        symbols.setdefault(r["bucket"], {})[r["number"]] = i
    shared = spark.sparkContext.broadcast(symbols)  # most words

    def cluster(batches):
        n = most + 2
        pairs = np.zeros(n * n)
        for b in batches:
            pairs[b.column(0).to_numpy()] = b.column(1).to_numpy()
        yield pa.RecordBatch.from_pydict({"of": [exchange(pairs.reshape(n, n), k).tolist()]})

    cells = blocks.answered(staged, _seed_symbols(numbered, shared, most), _seed_pairs(most), (np.int16,), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.repartition(1).mapInArrow(cluster, "of array<long>").collect()  # (most + 2) ** 2 cells at most
    of = np.array(got[0]["of"] if got else next(cluster([])).to_pylist()[0]["of"])  # an empty table may have no task

    kept, value = None, -np.inf
    classes = written(_first_classes(numbered, shared, of), "lm-classes")
    for r in range(rounds + 1):
        seen = written(blocks.answered(staged, classes.where("block > 0"), _profiles(r < rounds, k), (None, None), ANSWER, numbered=True), "lm-profiles")
        g = _square(seen.where("bucket = -1").mapInArrow(_class_pairs, "cell long, n long"), k + 1)
        if likelihood(g) <= value:
            break
        kept, value = (classes, g), likelihood(g)
        if r < rounds:
            had = numbered.where("block > 0").select("block", "bucket", "slots", F.lit(None).cast("binary").alias("blob")).union(classes.where("block = 0").select("block", "bucket", F.lit(None).cast("binary"), "blob"))
            classes = written(had.groupBy("bucket").cogroup(seen.where("bucket >= 0").groupBy("bucket")).applyInArrow(_moved(g, shared), ANSWER), "lm-classes")
    classes, g = kept if kept else (classes, g)
    once = np.zeros(k + 1)
    for r in _states(numbered, classes).mapInArrow(_once, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        once[r["class"]] = r["n"]
    return Model(numbered, classes, g, once, tokens, distinct, texts)


def scored(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and others) without its text, with held_out, n_tokens, n_known, train_tokens, base_score, score."""
    names = [o for o, _ in _OUTPUTS]
    row, columns = carried(docs, "text", "held_out", *names)
    docs, staged = prepared(docs.select(row, "doc_id", "text"))
    return scored_by(model_of(docs, staged), docs, staged).select(*columns, "held_out", *names)


_OUTPUTS = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]


def prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    bounded_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in {"held_out", "learn", *(o for o, _ in _OUTPUTS)}])
    docs = docs.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))).withColumn("learn", ~F.col("held_out"))
    return docs, blocks.staged(docs, _split, "veritab_lm", weight="learn")


def scored_by(model: Model, docs: DataFrame, staged: DataFrame) -> DataFrame:
    move, size_of, unknown = model.tables()
    tokens, distinct, texts, end = model.tokens, model.distinct, model.texts, len(size_of) - 1

    def finish(rows: pa.Table, size: np.ndarray, code: np.ndarray, got) -> pa.Table:
        n = int(code.max()) + 1 if len(code) else 0
        count, kind = np.zeros(n, np.int64), np.full(n, end + 1, np.int64)
        for _, place, tag, data in got:
            if tag[0]:
                kind[place] = np.frombuffer(data, np.uint8)
            else:
                count[place] = blocks.from_planes(data, 8)
        over = np.log10(tokens + 1 * (distinct + 1))
        base_of = np.log10(count + 1) - over
        known_of = kind < end
        own = np.where(known_of, kind, 0)
        emit_of = np.where(known_of, np.log10((1 - unknown[own]) * np.maximum(count, 1) / np.maximum(size_of[own], 1)), 0.0)
        seq, inner = _sequence(kind, size, code, end)
        value, base, known = np.zeros(len(seq)), np.full(len(seq), np.log10(texts + 1) - over), np.full(len(seq), texts > 0)
        value[inner], base[inner], known[inner] = emit_of[code], base_of[code], count[code] > 0
        value += move[np.concatenate([[end], seq[:-1]]), seq]
        start = np.cumsum(size + 1) - 1 - size
        made = {"n_tokens": size + 1, "n_known": np.add.reduceat(known.astype(np.int64), start), "train_tokens": np.full(len(size), tokens), "base_score": np.add.reduceat(base, start), "score": np.add.reduceat(value, start)}
        rows = rows.drop_columns(["learn"])
        for name, values in made.items():
            rows = rows.append_column(name, pa.array(values, pa.float64() if "score" in name else pa.int64()))
        return rows

    answers = model.numbered.where("block > 0").select("block", "bucket", "blob").union(model.classes.where("block > 0").select("block", "bucket", "blob"))
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ("text", "learn")] + [T.StructField(*o) for o in _OUTPUTS])
    return blocks.answered(staged, answers, finish, (np.uint8, None), schema)


def op10_lm(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
