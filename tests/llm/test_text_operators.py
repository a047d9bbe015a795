"""Operators on texts against brute force, with nulls, empties, repeats, long texts and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from veritab.llm import bpe, decontaminate, licenses, lm, quality, simhash, toxicity

WORDS = [f"w{i}" for i in range(60)] + ["É", "ñu", "Über", "the", "The"]
LONG = " ".join(random.Random(3).choices(WORDS, k=30_000))
DOCS = "doc_id long, text string, score string, _h string, items string"


def texts(n=40, seed=1):
    r = random.Random(seed)
    out = [" ".join(r.choices(WORDS, k=r.randint(1, 60))) for _ in range(n)]
    return out + [out[0], out[0] + " extra", None, "", "   \n\n ", "one two", "one two", LONG, "!!!", "a\x0bb c"]


def frame(spark, own):
    rows = [(i, t, "s", "h", "i") for i, t in enumerate(own)] + [(0, own[0], "s", "h", "i"), (None, own[1], "s", "h", "i"), (None, None, "s", "h", "i")]
    return spark.createDataFrame(rows, DOCS).repartition(3), [(r[0], r[1]) for r in rows]


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def simhash_brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    docs, rows = frame(spark, texts())
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((i, simhash_brute(t)) for i, t in rows)


@pytest.mark.parametrize("meet", [4096, 3])
def test_components_of_near_fingerprints(spark, meet):
    """Dense groups, chains and lone fingerprints; meet = 3 makes every meeting a large one."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(6)]
    fps = {0}
    for b in base:
        for _ in range(25):
            x = b
            for bit in r.sample(range(64), r.randint(0, 6)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.labelled(prints, meet=meet).collect()}
    expected = {}
    for i, f in enumerate(fps):
        expected.setdefault(find(f), []).append(i)
    assert got == {i: min(own) for own in expected.values() for i in own}
    assert 1 < len(expected) < len(fps)


def test_deduplicated_keeps_one_row_of_each_group(spark):
    docs, rows = frame(spark, texts())
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = Counter(r.doc_id for r in kept.collect())
    assert set(got) == set(groups.values()) and set(got.values()) == {1}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.deduplicated(docs).count() == 0
    assert bpe.tokenized(docs).count() == 0
    assert lm.scored(docs).count() == 0
    assert licenses.license_scan(docs).count() == 0
    assert quality.quality(docs, labels).count() == 0
    assert toxicity.toxicity(docs, labels).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).count() == 0
    some, rows = frame(spark, texts())
    assert decontaminate.decontaminate(some, items).where("contaminated").count() == 0
    assert decontaminate.clean(some, items).count() == len(rows)


def contamination_brute(rows, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(ascii_lower(t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                windows.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                own = windows.get(tuple(w[k : k + n]))
                if own:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, small, monkeypatch):
    own = texts()
    items = [(1, " ".join(LONG.split()[100:130])), (2, own[3]), (3, "one-two"), (4, None), (5, ""), (None, own[4]), (6, own[5].upper()), (2, own[6]), (7, "the É")]
    docs, rows = frame(spark, own)
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(decontaminate, "HOT_ROWS", 3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect())
    expected = contamination_brute(rows, items)
    assert got == expected
    assert decontaminate.clean(docs, bench).count() == sum(n for k, n in expected.items() if not k[4])


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_file())
    own = texts() + ["x<|endoftext|>y", "<|endoftext|>", "it's we'll", "漢字 テスト", "🙂🙂\r\n\t", "  lead", "tail  ", "ǅͅx   y"]
    docs, rows = frame(spark, own)
    got = bpe.tokenized(docs, outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded"))
    assert got.columns == ["doc_id", "score", "_h", "items", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "decoded"]
    expected = []
    for d, x in rows:
        e = t.encode(x or "", add_special_tokens=False).ids
        back = t.decode(e, skip_special_tokens=False)
        expected.append((d, len(e), tuple(e), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids), r.ids_sha256, r.decoded_sha256, r.decoded) for r in got.collect()) == Counter(expected)


def test_blocks_of_any_size(spark, monkeypatch):
    from veritab.llm import blocks

    docs, rows = frame(spark, texts())
    whole = Counter((r.doc_id, r.ids_sha256) for r in bpe.tokenized(docs, outputs=("ids_sha256",)).collect())
    assert Counter((r.doc_id, r.ids_sha256) for r in bpe.tokenized(docs, outputs=("ids_sha256",), buckets=70_000).collect()) == whole
    monkeypatch.setattr(blocks, "BLOCK_WORDS", 20)
    assert Counter((r.doc_id, r.ids_sha256) for r in bpe.tokenized(docs, outputs=("ids_sha256",)).collect()) == whole


def test_language_model(spark):
    """Counts and base scores by hand; scores by hand from the words' classes."""
    docs, rows = frame(spark, texts(120))
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t or ""))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update([*cut(t), None])
    n, v = sum(c.values()), len(c)
    expected = {(d, t): (held(d), len(cut(t)) + 1, sum(c[w] > 0 for w in [*cut(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*cut(t), None])) for d, t in rows}
    own, staged = lm.prepared(docs.withColumn("copy", F.col("text")))
    classes = 6
    model = lm.model_of(own, staged, 20, classes)
    got = lm.scored_by(model, own, staged).collect()
    vocabulary = {r.word: (r.n, r["class"]) for r in model.vocabulary().collect()}
    assert {w: k for w, (k, _) in vocabulary.items()} == {w: k for w, k in c.items() if w is not None}
    assert all(0 <= k < classes for _, k in vocabulary.values())
    kind = lambda w: classes if w is None else vocabulary[w][1] if w in vocabulary else None
    k = classes + 1
    pairs, size, once = [[0] * k for _ in range(k)], [0] * k, [0] * k
    for d, t in rows:
        if not held(d):
            for x, y in itertools.pairwise([None, *cut(t), None]):
                pairs[kind(x)][kind(y)] += 1
                size[kind(y)] += 1
    for m, x in vocabulary.values():
        once[x] += m == 1
    share = [(x + 1) / (sum(size) + k) for x in size]
    step = [[(pairs[x][y] + lm.ALPHA * share[y]) / (sum(pairs[x]) + lm.ALPHA) for y in range(k)] for x in range(k)]
    rest = [(once[x] + 1) / (size[x] + 2) for x in range(classes)] + [0]
    mass = [(size[x] + 1) * rest[x] for x in range(k)]

    def score(t):
        total, at = 0.0, [float(x == classes) for x in range(k)]
        for w in [*cut(t), None]:
            ahead = [sum(at[x] * step[x][y] for x in range(k)) for y in range(k)]
            if kind(w) is None:
                total += math.log10(sum(a * b for a, b in zip(ahead, rest, strict=True)))
                at = [x / sum(mass) for x in mass]
            else:
                y = kind(w)
                total += math.log10(ahead[y] * (1 if w is None else (1 - rest[y]) * vocabulary[w][0] / size[y]))
                at = [float(x == y) for x in range(k)]
        return total

    assert len(got) == len(rows)
    for r in got:
        e = expected[r.doc_id, r.copy]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4] and r.base_score == pytest.approx(e[4], rel=1e-9)
        assert r.score == pytest.approx(score(r.copy), rel=1e-9)


def test_classes_gather_words_of_one_kind(spark):
    """Nouns and verbs that alternate: words beyond the seeds find the seeds' classes from their neighbours."""
    r = random.Random(1)
    noun, verb = [f"n{i}" for i in range(40)], [f"v{i}" for i in range(40)]
    weights = [200] * 4 + [5] * 36
    rows = [(i, " ".join(w for _ in range(30) for w in (r.choices(noun, weights)[0], r.choices(verb, weights)[0]))) for i in range(60)]
    own, staged = lm.prepared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    model = lm.model_of(own, staged, 8, 2)
    of = {x.word: x["class"] for x in model.vocabulary().collect()}
    assert len({of[w] for w in of if w[0] == "n"}) == 1 and len({of[w] for w in of if w[0] == "v"}) == 1 and of["n0"] != of["v0"]


def test_exchange_ends_where_no_move_helps():
    import numpy as np

    r = np.random.default_rng(4)
    pairs = r.poisson(2.0, size=(20, 20)).astype(float)
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()

    def gain(of):
        m = np.eye(4)[of]
        g = m.T @ pairs @ m
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    of = lm.exchange(pairs, classes=3, rounds=100)
    assert of[-1] == 3 and (of[:-1] < 3).all()
    best = gain(of)
    for s in range(19):
        for c in range(3):
            other = of.copy()
            other[s] = c
            assert gain(other) <= best + 1e-6


def test_licenses(spark):
    mit = licenses.default_templates()["mit"]
    own = [None, "", "All rights reserved.", "x y\nLicensed under the Apache License, Version 2.0.\nz", "Licensed under the good old Apache License, Version 2.0.", LONG + " Released under the MIT License. " + LONG, "licensed as it is", mit.upper()]
    docs, rows = frame(spark, own)
    got = {r.doc_id: [(x.template, x.coverage) for x in r.reports] for r in licenses.license_scan(docs).collect() if r.doc_id is not None}
    assert got[2] == [("all-rights-reserved", 1.0)] and got[3] == [("apache-2.0-notice", 1.0)] and got[5] == [("mit-notice", 1.0)] and got[7] == [("mit", 1.0)]
    assert got[4] == [("apache-2.0-notice", 1.0)] and got[1] == got[6] == []
    spans = {r.doc_id: r.reports for r in licenses.license_scan(docs).collect()}
    assert own[3].encode()[spans[3][0].start : spans[3][0].end] == b"Licensed under the Apache License, Version 2.0"
    many = licenses.license_scan(docs, {f"t{i}": f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(50)} | {"m": licenses.NOTICES["mit-notice"]})
    assert [x.template for r in many.where("doc_id = 5").collect() for x in r.reports] == ["m"]


def _word_hashes(text):
    import numpy as np

    from veritab.llm import bytesarr

    data = np.frombuffer(text.encode(), np.uint8)
    return bytesarr.word_hashes(data, np.array([0, len(data)]))[2]


def test_whole_licenses_and_what_tells_them_apart(spark):
    """Each whole text finds itself best, also with edits; two clauses are not three."""
    r = random.Random(1)
    own = licenses.default_templates()
    names = [n for n in own if n not in licenses.NOTICES]
    edited = [" ".join(w for w in own[n].split() if r.random() > 0.03) for n in names]
    short = [n for n in names if len(own[n]) < 12_000]
    names, edited = short, [t for t, n in zip(edited, names, strict=True) if n in short]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([own[n] for n in names] + edited)], "doc_id long, text string").repartition(4)
    for x in licenses.license_scan(docs).collect():
        best = max((y for y in x.reports if y.best), key=lambda y: y.matched)
        assert best.template == names[x.doc_id % len(names)] and (best.coverage == 1.0 if x.doc_id < len(names) else best.coverage > 0.9)
        if best.template == "bsd-2-clause":
            assert all(y.coverage < best.coverage for y in x.reports if y.template == "bsd-3-clause")


def test_notices_that_follow_each_other(spark):
    """Runs of notices, with single words changed or put in between, against where they were put."""
    r = random.Random(5)
    own = {n: licenses.NOTICES[n] for n in ("all-rights-reserved", "mit-notice", "cc-by-nc-4.0-notice", "gpl-3.0-notice", "cc-by-4.0-notice")}
    texts, expected = [], []
    for _ in range(60):
        words, put = [], []
        for _ in range(r.randint(1, 12)):
            name = r.choice(list(own))
            notice = re.findall(r"[A-Za-z0-9]+", own[name])
            if len(notice) >= 10 and r.random() < 0.4:
                notice[r.randrange(1, len(notice) - 1)] = "zzz"
            words += r.choices(WORDS[:40], k=r.choice([0, 0, 0, 3]))
            put.append((name, len(words), len(words) + len(notice) - 1))
            words += notice
        texts.append(" ".join(words))
        expected.append(sorted(put))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: sorted((y.template, y.first_word, y.last_word) for y in x.reports) for x in licenses.license_scan(docs, own).collect()}
    assert [got[i] for i in range(60)] == expected


def test_seeds_lose_nothing():
    """Reports from fingerprints are those from all diagonals, exact copies at any place; overlapping templates of equal coverage are both told."""
    r = random.Random(6)
    index = licenses.Index({"a": " ".join(f"t{i}" for i in range(12)), "b": " ".join(f"t{i}" for i in range(4, 16)), "c": "u v"})
    for _ in range(40):
        words = []
        for _ in range(r.randint(1, 5)):
            words += r.choices(["x", "y", "t3", "u"], k=r.randint(0, 4)) + [f"t{i}" for i in range(16)][r.choice([0, 4]) :][: r.choice([12, 16])] + r.choice([[], ["u", "v"]])
        hashes, seeds = _word_hashes(" ".join(words)), index.seeds(_word_hashes(" ".join(words)))
        for t, template in enumerate(index.words):
            every = [(p, 0) for p in range(len(hashes))]
            exact = [p for p in range(len(hashes) - len(template) + 1) if (hashes[p : p + len(template)] == template).all()]
            got = licenses.spans(template, hashes, seeds.get(t, []), 8, 1.0)
            assert [a for _, a, b in got if b - a + 1 == len(template)] == exact and len(got) == len(licenses.spans(template, hashes, every, 8, 1.0))
    both = licenses._marked(licenses.reports(index, _word_hashes(" ".join(f"t{i}" for i in range(16))), *[__import__("numpy").zeros(16, int)] * 2, 8, 0.8))
    assert [(x["template"], x["coverage"], x["best"]) for x in both] == [("a", 1.0, True), ("b", 1.0, False)]


def test_alignment_like_the_full_table():
    import numpy as np

    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    r = random.Random(2)
    for _ in range(50):
        a, b = [r.randrange(5) for _ in range(r.randint(1, 9))], [r.randrange(5) for _ in range(r.randint(1, 9))]
        most, first, last = licenses.aligned(np.array(a), np.array(b), 0, 20)
        assert most == lcs(a, b)
        ends = [j for j in range(len(b)) if lcs(a, b[: j + 1]) == most]
        starts = [i for i in range(len(b)) if most and lcs(a, b[i : ends[0] + 1]) == most]
        assert (first, last) == ((starts[-1], ends[0]) if most else (-1, -1))


def labelled_docs(spark, bad, n=300, repeat=1):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        t = " ".join(r.choices(WORDS, k=60)).replace("w1", "w1.\n")
        poor = i % 4 == 0
        rows.append((i, bad(t, r) if poor else t))
        labels.append((i, int(not poor), int(poor)))
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, LONG), (None, "w2 w3"), (5, rows[5][1])]
    labels += [(1, None, None), (None, 1, 1), (99999, 0, 1), (2, 1, 0)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, predicted string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(rows)


def judged(out, n, wrong):
    rows = out.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 300 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len(own) > 30 and sum(r.predicted == wrong(r.doc_id) for r in own) <= 0.05 * len(own)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}


def test_quality_on_held_out(spark):
    docs, labels, n = labelled_docs(spark, lambda t, r: " ".join(w + r.choice(["###", "&&&"]) for w in t.split()))
    judged(quality.quality(docs, labels), n, lambda d: int(d % 4 == 0))


def test_toxicity_on_held_out(spark):
    docs, labels, n = labelled_docs(spark, lambda t, r: t + " " + " ".join(r.choices(["vile", "rotten"], k=3)))
    judged(toxicity.toxicity(docs, labels), n, lambda d: int(d % 4 != 0))


def test_forward_backward_like_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    emit, move, text_of = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 0, 0, 0, 1, 2, 2])
    good, pairs, _ = quality.marginals(emit, move, text_of)
    expected, expected_pairs = np.zeros(7), np.zeros((2, 2))
    for t in range(3):
        at = np.flatnonzero(text_of == t)
        weights = {}
        for s in itertools.product([0, 1], repeat=len(at)):
            weights[s] = np.exp(sum(emit[at[k]] * s[k] for k in range(len(at))) + sum(move[a, b] for a, b in itertools.pairwise(s)))
        z = sum(weights.values())
        for s, w in weights.items():
            expected[at] += np.array(s) * w / z
            for a, b in itertools.pairwise(s):
                expected_pairs[a, b] += w / z
    assert np.allclose(good, expected) and np.allclose(pairs, expected_pairs)


def test_scores_do_not_see_ids_or_labels(spark):
    docs, labels, _ = labelled_docs(spark, lambda t, r: t + " vile")
    model = toxicity.train(docs, labels)
    a = toxicity.scored(docs.select("doc_id", "text"), model)
    b = toxicity.scored(docs.select((F.col("doc_id") + 7).alias("doc_id"), "text"), model)
    assert sorted(r.score for r in a.collect()) == sorted(r.score for r in b.collect())
