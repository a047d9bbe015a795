"""Fitted models and whole runs of the pipeline against plain versions."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest

from tests.llm.test_neardup import kept_brute
from tests.llm.test_text_operators import contamination_brute
from veritab.llm import bpe, bytesarr, quality, toxicity


def test_ftrl_like_the_published_steps():
    r = random.Random(2)
    rows = [sorted({r.randrange(40) for _ in range(r.randint(0, 8))} | ({77} if i % 3 == 0 else set())) for i in range(60)]
    labels = np.array([float(i % 3 == 0) for i in range(60)])
    bias, at, w = toxicity.fit([np.array(x, np.int32) for x in rows], labels, epochs=5)
    z, n, order = {}, {}, np.random.default_rng(7)
    b = math.log(labels.mean() / (1 - labels.mean()))
    bn = 1.0

    def weight(f):
        zf = z.get(f, 0.0)
        if abs(zf) <= toxicity.L1:
            return 0.0
        return -(zf - math.copysign(toxicity.L1, zf)) / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(5):
        for k in order.permutation(60):
            own = {f: weight(f) for f in rows[k]}
            g = 1 / (1 + math.exp(-(b + sum(own.values())))) - labels[k]
            for f, wf in own.items():
                sigma = (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA
                z[f] = z.get(f, 0.0) + g - sigma * wf
                n[f] = n.get(f, 0.0) + g * g
            bn += g * g
            b -= 0.05 * g / math.sqrt(bn)
    expected = {f: weight(f) for f in z if weight(f)}
    assert bias == pytest.approx(b) and dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(expected)
    assert 77 in expected and len(expected) < len(z)  # L1 leaves out what says little


def test_toxicity_scores_by_hand(spark):
    r = random.Random(3)
    own = [" ".join(r.choices(["ok", "fine", "Vile", "rotten", "thing"], k=r.randint(0, 12))) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)

    def features(t):
        data = np.frombuffer((t or "").encode(), np.uint8)
        h = bytesarr.word_hashes(data, np.array([0, len(data)]))[2]
        return set(toxicity.features(h, np.zeros(len(h), np.int64))[0].tolist())

    every = sorted(set().union(*map(features, own)))
    model = -0.3, np.array(every[::2]), np.array([r.uniform(-1, 1) for _ in every[::2]])
    weights = dict(zip(model[1].tolist(), model[2].tolist(), strict=True))
    for x in toxicity.scored(docs, model).collect():
        total = model[0] + sum(weights.get(f, 0.0) for f in features(own[x.doc_id]))
        assert x.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-4)


def test_quality_scores_by_hand(spark):
    """Marginals of each text by enumeration, weighted by length, through the fitted map."""
    r = random.Random(4)
    line = lambda: " ".join(r.choices(["words", "more", "##", "12", "A"], k=r.randint(1, 6)))
    own = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(30)] + [None, "", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    move = np.array(model["move"]).reshape(2, 2)
    for x in quality.scored(docs, model).collect():
        data = np.frombuffer((own[x.doc_id] or "").encode(), np.uint8)
        figures, length, text_of = quality.line_figures(data, np.array([0, len(data)]))
        emit = quality.with_neighbours((figures - np.array(model["mean"])) / np.array(model["sd"]), text_of) @ np.array(model["w"])
        good, z = np.zeros(len(emit)), 0.0
        for s in itertools.product([0, 1], repeat=len(emit)):
            weight = math.exp(sum(e * y for e, y in zip(emit, s, strict=True)) + sum(move[a, b] for a, b in itertools.pairwise(s)))
            good, z = good + weight * np.array(s), z + weight
        q = float((good / z * length).sum() / length.sum()) if len(emit) else 0.5
        total = model["a"] * math.log((q + 1e-3) / (1 - q + 1e-3)) + model["b"]
        assert x.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)


def pipeline_rows():
    r = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    own = [" ".join(r.choices(words, k=r.randint(20, 60))) for _ in range(20)]
    item = " ".join(r.choices(words, k=14))
    own += [own[0], own[1] + " end", own[2].upper(), "before " + item + " after", item, "", None, "one two", " ".join(r.choices(words, k=20_000))]
    return [(i, t) for i, t in enumerate(own)] + [(3, own[3]), (None, own[4]), (None, None), (5, "another text of five")], [(1, item), (2, None), (None, own[6])]


def written(spark, where, rows, items, labels=()):
    kind = "doc_id long, text string, _quality string, _toxicity string, sid string, root string, h string, n_tokens string"
    spark.createDataFrame([(*x, "q", "t", "s", "r", "h", "n") for x in rows], kind).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_a_run_over_odd_rows(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    rows, items = pipeline_rows()
    got = P.run(spark, written(spark, tmp_path, rows, items)).collect()
    kept = kept_brute([(math.inf if d is None else d, t) for d, t in rows])
    clean = []
    for d, t in {(math.inf if d is None else d, t) for d, t in rows if (math.inf if d is None else d) in kept}:
        if not contamination_brute([(0, t)], items).most_common(1)[0][0][4]:
            clean.append((d, t))
    t = Tokenizer.from_file(bpe.default_file())
    ids_of = {d: t.encode(x or "", add_special_tokens=False).ids for d, x in clean if d != 5}
    assert len(got) == len(kept) - 1  # what holds the item: its near copy has gone before
    assert {"_quality", "_toxicity", "sid", "root", "h"} <= set(got[0].asDict()) and all((x._quality, x.root) == ("q", "r") for x in got)
    for x in got:
        if x.doc_id in ids_of:
            assert list(x.ids) == ids_of[x.doc_id] and x.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in x.ids)).hexdigest()


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    where = written(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for name, stage in P.STAGES:
        out = stage(spark, docs, where)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)
    assert P.run(spark, where).count() == 0
