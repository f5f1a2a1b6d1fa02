"""Every registered query against its DuckDB twin on the smallest tables."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

from conftest import SF_SMALL

KEYS = sorted(k for k in E.queries() if k in E.registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(spark, key, SF_SMALL, con)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["query_id", "point_id", "rank", "score", "headline", "lang", "source"]


def test_lsh_recall_reported(spark):
    r = E.queries()["lsh_recall"](spark, SF_SMALL).collect()
    assert r and all(0.0 <= x.recall <= 1.0 for x in r)
    assert sum(x.found for x in r) > 0


def test_small_prefetch_cuts(spark):
    """With 25 per branch the cascade is not the exhaustive search."""
    rows = lambda k: sorted(map(tuple, E.queries()[k](spark, SF_SMALL).collect()))
    assert rows("rerank_late_n25") != rows("late_topk")
