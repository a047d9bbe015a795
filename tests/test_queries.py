"""Every query over the driver's tables against its SQL, on the smallest tables."""

import pytest

from tests.conftest import SF
from veritab.plans import document_queries, finding_queries, ingest_queries, rule_queries  # noqa: F401  (they add their queries)
from veritab.plans.queries import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(text(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    expected = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(expected.fetchall(), names)


def test_full_run_over_the_tables(spark):
    """What disagrees among the parts' sentences is found, from positioned items on; numbering is dense and in order."""
    rows = QUERIES["full_run"](spark, SF).orderBy("id").collect()
    found = {r.conceptKey for r in rows}
    assert {"sample_size.planned~sample_size.randomised", "safety.followup_window", "schedule.visit_window", "derivation.code_hygiene", "standard.spelling.separate", "stat.alpha"} <= found
    rank = {"CRITICAL": 0, "MAJOR": 1, "MINOR": 2}
    ordered = sorted(rows, key=lambda r: int(r.id[2:]))
    assert [int(r.id[2:]) for r in ordered] == list(range(1, len(rows) + 1)) and [(rank[r.severity], -r.confidence) for r in ordered] == sorted((rank[r.severity], -r.confidence) for r in rows)
