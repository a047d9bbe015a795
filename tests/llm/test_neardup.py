"""Near-duplicates of the pipeline against brute force."""

import random
import re

from pyspark.sql import functions as F

from tests.conftest import SF
from veritab.llm import neardup


def shingle_set(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def kept_brute(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and jaccard(sets[i], sets[j]) >= 0.8:
                root[of(i)] = of(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(of(i), []).append(d)
    return sorted(min(g) for g in groups.values())


def edited(words, share, r):
    return " ".join(f"edit{r.randrange(10**6)}" if r.random() < share else w for w in words)


def test_planted_copies(spark):
    r = random.Random(4)
    base = [x for (x,) in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").orderBy("doc_id").select("text").collect()]
    base = [x.encode("ascii", "ignore").decode().split() for x in base]
    base = [w for w in base if 60 <= len(w) <= 3000][:60]
    rows, bins = [], {80: 0, 85: 0, 90: 0, 95: 0}
    for w in base:
        own = shingle_set(" ".join(w))
        rows.append((len(rows), " ".join(w)))
        for share in (0.005, 0.012, 0.018, 0.023, 0.03):
            copy = edited(w, share, r)
            j = jaccard(own, shingle_set(copy))
            if 0.8 <= j < 1:
                bins[int(j * 20) * 5] += 1
            rows.append((len(rows), copy))
    assert all(n >= 10 for n in bins.values()), bins
    rows += [(len(rows) + i, x) for i, x in enumerate(["", " ", "one two", "One  two", "one three"])]
    got = sorted(x.doc_id for x in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    expected = kept_brute(rows)
    assert len(set(got) ^ set(expected)) <= 0.01 * (len(rows) - len(expected))


def test_large_meeting_and_links_below(spark):
    """Forty copies that all meet, one part of a group apart from the rest, and pairs just below the limit."""
    r = random.Random(6)
    w = [f"w{r.randrange(10**5)}" for _ in range(300)]
    rows = [(i, edited(w, 0.004, r)) for i in range(40)]
    rows += [(100 + i, edited(edited(w, 0.06, random.Random(7)).split(), 0.004, r)) for i in range(30)]
    rows += [(200, " ".join(w[:230])), (201, None), (202, "")]
    got = sorted(x.doc_id for x in neardup.deduplicated(spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, sid string")).collect())
    assert got == kept_brute(rows)
    assert neardup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_that_share_most_but_not_enough(spark):
    """A text with one or two words changed in each of 300 copies: they meet, and only some are similar."""
    r = random.Random(8)
    w = [f"w{r.randrange(10**5)}" for _ in range(40)]
    rows = []
    for i in range(300):
        own = list(w)
        for _ in range(r.choice([1, 1, 2])):
            own[r.choice([0, 1, 38, 39, r.randrange(40)])] = f"x{r.randrange(60)}"
        rows.append((i, " ".join(own)))
    got = sorted(x.doc_id for x in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == kept_brute(rows) and 10 < len(got) < 290


def test_rare_keys_hold_every_similar_pair(spark):
    r = random.Random(9)
    sets = []
    for i in range(120):
        base = list(range(1000 * (i // 4), 1000 * (i // 4) + [3, 9, 30, 70, 200][i // 4 % 5]))
        sets.append((i, sorted({x if r.random() > 0.03 else 10**6 + r.randrange(10**5) for x in base})))
    keyed = neardup.rare_keys(spark.createDataFrame(sets, "sid long, s array<long>")).collect()
    of = {}
    for x in keyed:
        of.setdefault(x.sid, set()).add(x.k)
    similar = [(i, j) for i, a in sets for j, b in sets if i < j and jaccard(set(a), set(b)) >= 0.8]
    assert len(similar) > 20 and all(of[i] & of[j] for i, j in similar)


def test_overlaps_like_sets():
    r = random.Random(3)
    import numpy as np

    sets = [np.array(sorted(r.sample(range(-50, 20_000 if i % 2 else 80), r.randint(0, 60))), np.int64) for i in range(30)]
    got = neardup.overlaps(sets[:12], sets[12:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[12:]] for a in sets[:12]]


def test_stage_on_the_table(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = dict(P.STAGES)["near-dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(x.doc_id for x in got.collect()) == kept_brute([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()])


def test_sets_meet_by_simhash_too(spark):
    """Where no band of minima is shared, texts within four bits of each other's SimHash still meet, and are verified."""
    from veritab.llm.simhash import DISTANCE, fingerprint

    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"v{i}" for i in range(600))]
    prints = [fingerprint(x.encode()) for x in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= DISTANCE < (prints[0] ^ prints[2]).bit_count()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    apart = neardup.sketches(docs.select("doc_id", F.xxhash64("text").alias("h"), "text")).withColumn("bands", F.array(F.xxhash64("sid", F.lit("no other's"))))
    ids = {r.sid: r.doc_id for r in apart.select("sid", "doc_id").collect()}
    assert [{ids[r.a], ids[r.b]} for r in neardup.links(apart.drop("doc_id"), docs).collect()] == [{0, 1}]
