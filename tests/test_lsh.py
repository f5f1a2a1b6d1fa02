"""LSH and block search: what they move, and results against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyrank.operators import retrieve


def vectors(spark, n=400, dim=8, copies=60):
    rng = np.random.default_rng(21)
    x = rng.standard_normal((n, dim))
    x[:copies] = x[0]                                    # one crowded bucket a table
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows + [(n, None)], "point_id long, dense array<double>")


def plain(x, k, tables, bits, seed):
    planes = retrieve._hyperplanes(x.shape[1], tables, bits, seed)
    codes = (np.einsum("nd,tbd->ntb", x, planes) > 0) @ (1 << np.arange(bits))
    out = set()
    for q in range(len(x)):
        met = np.flatnonzero((codes == codes[q]).any(axis=1))
        best = sorted(((-round(float(x[p] @ x[q]), 6), int(p)) for p in met))[:k]
        out |= {(q, p, r + 1) for r, (_, p) in enumerate(best)}
    return out


@pytest.mark.parametrize("part", [1 << 15, 7])
def test_lsh_equals_the_plain_search_of_its_candidates(spark, monkeypatch, part):
    monkeypatch.setattr(retrieve, "LSH_PART", part)
    x, pts = vectors(spark)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    got = {(r.query_id, r.point_id, r["rank"]) for r in retrieve.dense_lsh_topk(pts, q, 10, tables=4, bits=3, dim=8).collect()}
    assert got == plain(x, 10, 4, 3, 7)


def test_lsh_candidates_are_no_rows_of_a_shuffle(spark):
    _, pts = vectors(spark)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    plan = retrieve.dense_lsh_topk(pts, q, 10, tables=4, bits=3, dim=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan              # no pairs to make distinct


def test_rows_given_twice_are_found_twice(spark):
    _, pts = vectors(spark, 30, copies=1)
    twice = pts.unionByName(pts.where("point_id = 3"))
    q = pts.select(F.col("point_id").alias("query_id"), "dense").where("query_id = 3")
    got = [r.point_id for r in retrieve.dense_lsh_topk(twice, q, 5, tables=4, bits=2, dim=8).sort("rank").collect()]
    assert got[:2] == [3, 3]


def test_blocks_do_not_multiply_rows_beyond_what_the_cores_need(spark):
    _, pts = vectors(spark)
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    assert retrieve.side_blocks(pts, "dense", 80) <= most ** 0.5 + 1 < retrieve._n_blocks(pts, F.size("dense"), 80)
    assert retrieve.dense_topk_blocks(pts, q, 5, block_bytes=80).count() == 2000
