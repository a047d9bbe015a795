"""Neighbours, URL filters, WARC archives and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from veritab.llm import ann, urls, warc


def nearest(rows, queries, top=20):
    own = {}
    for i, v in rows:
        own.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in queries:
        scored = sorted((-max(float((own[q][0] * v).sum()) for v in vs), i) for i, vs in own.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:top]]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(1)
    good = [(i, r.normal(size=8).round(3).tolist()) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 340)]
    bad = [(500, None), (520, [0.0] * 8), (540, [1.0, float("nan")] + [0.0] * 6), (560, [1.0, None] + [0.0] * 6), (580, [1.0] * 3), (600, []), (620, [float("inf")] + [0.0] * 7), (None, [2.0] * 8)]
    again = [(20, good[20][1]), (301, [1.0] * 8)] + [(41, good[41][1])] * 50
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad + again], "vec_id long, embedding array<double>, rank int, score double").repartition(5)
    got = {}
    for x in ann.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    expected = nearest(good + again, [i for i, _ in good if i % 20 == 0])
    assert set(got) == set(expected)
    hits = 0
    for q, own in got.items():
        own.sort()
        assert [k for k, _, _ in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for i, _ in expected[q]})
        exact = dict(good)
        assert all(abs(s - float((np.array(exact[q]) * np.array(exact[i])).sum())) < 1e-9 for _, i, s in own)
    assert hits >= 0.9 * 20 * len(got)
    assert [i for _, i, _ in got[300]] == [i for i, _ in expected[300]]  # ties


def test_few_or_no_neighbours(spark):
    kind = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [-1.0, 0.0])], kind)
    assert [(x.rank, x.vec_id) for x in ann.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    for rows in ([], [(0, [1.0])], [(0, None)]):
        df = spark.createDataFrame(rows, kind)
        assert ann.neighbours(df, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    expected = nearest(rows, [i for i, _ in rows if i % 20 == 0])
    got = Counter((x.query_id, x.vec_id) for x in ann.op1_ann(spark, SF).collect())
    assert sum((q, i) in got for q, own in expected.items() for i, _ in own) >= 0.9 * sum(map(len, expected.values()))


def test_graph_search_finds_what_a_scan_finds():
    r = np.random.default_rng(2)
    c, q = r.normal(size=(80, 6)).astype(np.float32), r.normal(size=(30, 6)).astype(np.float32)
    ids, dist = ann.graph_search(q, c, ann.neighbour_graph(c), 80)
    scan = np.argsort(((q[:, None] - c) ** 2).sum(2), 1)
    assert (ids[:, :10] == scan[:, :10]).mean() > 0.95 and (np.diff(dist, axis=1) >= 0).all()


def test_urls(spark):
    rows = [
        (1, "http://www.example.com/en/x?a", None), (2, "https://EXAMPLE.com/en/", ""), (3, "http://a.com", None), (4, "http://a.com/", None), (5, "http://b.net/es/q#f", None), (6, "no scheme", "x"), (7, None, None),
        (8, "http://c.org/a", '<a href="http://b.net/x">'), (9, "http://d.org/b", "<a HREF='//good.com/'>"), (10, "http://good.com/z", '<a href=http://e.org/>'), (11, "http://e.org/", ""), (8, "http://c.org/a", None), (None, "x://h/p?u://v", None), (12, "ftp://notexample.com.x/en/", None)]
    df = spark.createDataFrame([(*r, "k", "v") for r in rows], "page_id long, url string, html string, rule string, host string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(df).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("a.com", "", None, "allow") and got[4][2:] == ("com/", "allow") and got[5] == ("b.net", "/es/q", "net/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[None] == ("h", "/p", None, "allow")
    assert got[8][3] == "block"  # it links to a blocked host
    assert got[11][3] == "allow" and got[12] == ("notexample.com.x", "/en/", None, "allow")
    assert urls.url_filter(df).count() == len(rows) and urls.url_filter(df.limit(0)).count() == 0


def test_host_mass_like_power_iteration(spark):
    r = random.Random(1)
    edges = {(r.randrange(9), r.randrange(9)): r.randint(1, 5) for _ in range(30)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = {0: (3.0, 0.0), 1: (0.0, 2.0), 2: (1.0, 1.0)}
    trust, distrust = np.zeros(9), np.zeros(9)
    out, into = Counter(), Counter()
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    base_t, base_d = np.zeros(9), np.zeros(9)
    for h, (a, b) in seeds.items():
        base_t[h], base_d[h] = 0.15 * a, 0.15 * b
    trust, distrust = base_t.copy(), base_d.copy()
    for _ in range(urls.ROUNDS):
        t, d = base_t.copy(), base_d.copy()
        for (a, b), n in edges.items():
            t[b] += 0.85 * trust[a] * n / out[a]
            d[a] += 0.85 * distrust[b] * n / into[b]
        trust, distrust = t, d
    judged = spark.createDataFrame([(str(h), v) for h, (a, b) in seeds.items() for v in ["allow"] * int(a) + ["block"] * int(b)], "host string, verdict string")
    links = spark.createDataFrame([(str(a), str(b), n) for (a, b), n in edges.items()], "src string, dst string, n long")
    got = {int(x.host): (x.trust, x.distrust) for x in urls.host_mass(judged, links).collect()}
    for h in range(9):
        assert got.get(h, (0.0, 0.0)) == pytest.approx((trust[h], distrust[h]), abs=1e-12)


@pytest.mark.parametrize("split", ["900", "128m"])
def test_warc(spark, tmp_path, split):
    big, fake = "z" * 1500, "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [
        (1, "http://a", big), (2, None, big), (3, "http://b\r\nx", None), (4, "u", "pre " + fake + " WARC/1.1\r\n" + "é" * 700 + fake), (5, "u", "WARC/1.1\r\nWARC/1.1\r\n"), (None, "u", big), (6, "u", "short"), (7, "u", "short"),
        (7, "v", "q" * 2000), (7, "v", "q" * 2000), (8, "w", fake), (9, "w", "long " * 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").coalesce(2)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        warc.write_archives(df, str(tmp_path / "w"))
        got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    expected = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        revisit = len(data) >= 1000 and ids and i != max(ids)
        expected[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(ids) if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected


def test_empty_archive(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_pipeline_stages(spark):
    """Each stage against its operator's decisions, on the small table, plus what must hold at the end."""
    import corpus_pipeline as P
    from tests.llm.test_neardup import kept_brute
    from tests.llm.test_text_operators import contamination_brute
    from veritab.llm import quality, toxicity
    from veritab.llm.common import table, written

    docs = table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert len(names) == 5 and names[2] == "near-dedup"
    stage = dict(P.STAGES)
    one = written(stage["quality"](spark, docs, SF), "t1")
    kept = {r.doc_id for r in quality.quality(docs.select("doc_id", "text"), table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept and len(kept) > 0.5 * docs.count()
    two = written(stage["toxicity"](spark, one, SF), "t2")
    kept = {r.doc_id for r in toxicity.toxicity(one.select("doc_id", "text"), table(spark, SF, "labels")).where("predicted = 0").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept
    three = written(stage["near-dedup"](spark, two, SF), "t3")
    assert three.columns == docs.columns and sorted(r.doc_id for r in three.collect()) == kept_brute([(r.doc_id, r.text) for r in two.collect()])
    four = written(stage["decontamination"](spark, three, SF), "t4")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {k[0] for k in contamination_brute([(r.doc_id, r.text) for r in three.collect()], items) if not k[4]}
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} == clean
    last = stage["bpe"](spark, four, SF)
    assert last.count() == four.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)
