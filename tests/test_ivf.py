"""The inverted-file index with quantised residuals against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyrank.operators import ivf, retrieve


def vectors(n=3000, dim=24, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.6 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors())] + [(9000, None)]
    return spark.createDataFrame(rows, "point_id long, dense array<double>").cache()


def test_recall_scores_and_share_of_lists(spark, points):
    q = ivf.fit(points)
    index = ivf.build(points, q)
    asks = points.where("point_id % 7 = 0 and point_id < 9000").select(F.col("point_id").alias("query_id"), "dense")
    got = {(r.query_id, r.point_id): r.score for r in ivf.search(index, q, points, asks, 10).collect()}
    want = {(r.query_id, r.point_id): r.score for r in retrieve.dense_topk(points, asks, 10).collect()}
    both = got.keys() & want.keys()
    assert len(both) >= 0.9 * len(want) and len(got) == len(want)
    assert all(got[x] == want[x] for x in both)                    # scores are exact
    assert q.probes < len(q.centroids) / 2
    assert index.count() == 3000 and index.where(F.length("code") != ivf.PARTS).isEmpty()


def test_all_lists_and_candidates_give_the_exact_result(spark, points):
    q = ivf.fit(points, lists=20)
    q.probes, q.keep = 20, 3000
    asks = points.where("point_id < 12").select(F.col("point_id").alias("query_id"), "dense")
    rows = lambda df: sorted((r.query_id, r["rank"], r.point_id, r.score) for r in df.collect())
    assert rows(ivf.search(ivf.build(points, q), q, points, asks, 10)) == rows(retrieve.dense_topk(points, asks, 10))


def test_only_probed_lists_are_read(spark, points):
    q = ivf.fit(points, lists=30)
    index = ivf.build(points, q)
    one = points.where("point_id = 5").select(F.col("point_id").alias("query_id"), "dense")
    plan = ivf.search(index, q, points, one, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.split("\n") if "FileScan" in x and "code" in x]
    assert scan and "list#" in scan[0].split("PartitionFilters: ")[1].split("]")[0]


def test_lists_follow_the_number_of_vectors(spark, points):
    few = ivf.fit(points.limit(100))
    assert len(few.centroids) == 20 and len(ivf.fit(points).centroids) == int(2 * 3000 ** 0.5)
    one = ivf.fit(points.limit(1))
    got = ivf.search(ivf.build(points.limit(1), one), one, points.limit(1), points.limit(1).select(F.lit(1).cast("long").alias("query_id"), "dense"), 3)
    assert got.count() == 1


def test_index_serves_the_dense_branch_of_every_strategy(spark):
    from hyrank import api
    from hyrank.plans.collection import corpus
    from conftest import SF_SMALL
    col, qs = corpus(spark, SF_SMALL)
    near = api.with_index(col, target=1.0)
    near.quantizer.probes, near.quantizer.keep = len(near.quantizer.centroids), 200          # all lists, all candidates: exact
    rows = lambda c, m: sorted((r.query_id, r["rank"], r.point_id) for r in api.search(c, qs, m, 10, **({"threshold": None} if m == "dense" else {"prefetch": 40} if m != "multistep" else {})).collect())
    for method in ("dense", "rrf_dense_sparse", "multistep"):
        assert rows(near, method) == rows(col, method)
    filtered = api.search(near, qs, "dense", 5, where=F.col("lang") == "en", threshold=None)
    assert "code" not in filtered._jdf.queryExecution().executedPlan().toString()            # a filter goes the exact way


def test_parts_of_queries_and_pairs_change_nothing(spark, points, monkeypatch):
    """Every vector asks: what a task holds follows QUERY_PART and PAIRS, not the number of queries."""
    q = ivf.fit(points)
    index = ivf.build(points, q)
    asks = points.where("point_id < 9000").select(F.col("point_id").alias("query_id"), "dense")
    rows = lambda df: sorted((r.query_id, r["rank"], r.point_id, r.score) for r in df.collect())
    want = rows(ivf.search(index, q, points, asks, 10))
    assert len(want) == 30_000
    monkeypatch.setattr(ivf, "QUERY_PART", 64 * q.keep * 100)          # 100 queries' candidates
    monkeypatch.setattr(ivf, "PAIRS", 64)
    assert rows(ivf.search(index, q, points, asks, 10)) == want
