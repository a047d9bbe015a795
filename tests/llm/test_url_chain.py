"""Propagation over more links than a fixed number of rounds would reach."""

from veritab.llm import urls


def test_chain_to_a_blocked_host(spark):
    n = 14
    rows = [(i, f"http://h{i}.org/", f'<a href="http://h{i + 1}.org/">') for i in range(n - 1)]
    rows += [(n - 1, f"http://h{n - 1}.org/", '<a href="http://example.com/en/">'), (n, "http://example.com/en/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    assert {r.page_id: r.verdict for r in urls.url_filter(pages).collect()} == dict.fromkeys(range(n + 1), "block")
