"""Plan shape: what the optimizer does with our operators."""

from pyspark.sql import functions as F

from hyrank.operators import shape
from hyrank.plans.collection import corpus
from hyrank.plans import strategies as S

from conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_uses_window_group_limit(spark):
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.sparse(col, qs, 10))
    assert "WindowGroupLimit" in p
    p = plan(S.sparse(col, qs, 10, where=F.col("lang") == "en"))
    assert "WindowGroupLimit" in p
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_large_prefetch_keeps_group_limit(spark):
    col, qs = corpus(spark, SF_SMALL)
    assert "WindowGroupLimit" in plan(S.sparse(col, qs, 1500))


def test_payload_projection_never_reads_vectors(spark):
    col, qs = corpus(spark, SF_SMALL)
    h = S.sparse(col, qs, 10)
    p = plan(shape.project_hits(h, col.points, ["headline"]))
    scans = [line for line in p.split("\n") if "FileScan parquet" in line and "points" in line]
    assert scans
    for line in scans:
        schema = line.split("ReadSchema:")[-1]
        assert "dense" not in schema and "late" not in schema


def test_payload_filter_pushed_to_scan(spark):
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.dense(col, qs, 10, threshold=None, where=F.col("lang") == "en"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in p


def test_postings_scan_prunes_columns(spark):
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.sparse(col, qs, 10, where=F.col("lang") == "en"))
    line = [x for x in p.split("\n") if "FileScan parquet" in x and "postings" in x][0]
    assert "tf" not in line.split("ReadSchema:")[-1] and "dl" not in line.split("ReadSchema:")[-1]


def test_small_query_batch_pushes_term_filter(spark):
    from hyrank.plans.collection import QuerySet
    col, qs = corpus(spark, SF_SMALL)
    one = QuerySet(qs.queries.where(F.col("query_id") == 1), qs.terms.where(F.col("query_id") == 1), 1)
    p = plan(S.sparse(col, one, 10, where=F.col("lang") == "en"))
    line = [x for x in p.split("\n") if "FileScan parquet" in x and "postings" in x][0]
    assert "In(term, [" in line.split("PushedFilters: ")[1]


def test_dense_threshold_scores_once(spark):
    """The threshold is applied inside the scoring kernel: one Arrow pass over
    the points, no score expression re-evaluated in a filter or join."""
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.dense(col, qs, 10, threshold=0.6))
    assert p.count("MapInArrow") == 1
    assert "aggregate(" not in p and "zip_with" not in p


def test_sparse_filter_reaches_the_postings_scan_below_the_aggregate(spark):
    """Covering postings carry the filterable payload: no join with the points."""
    col, qs = corpus(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(S.sparse(col, qs, 10, where=F.col("lang") == "en"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = p.split("\n")
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "postings" in x)
    assert "EqualTo(lang,en)" in lines[scan]
    assert any("HashAggregate" in x for x in lines[:scan])
    assert not any("/points" in x for x in lines if "FileScan" in x)


def test_filter_on_other_payload_falls_back_to_the_points(spark):
    col, qs = corpus(spark, SF_SMALL)
    got = S.sparse(col, qs, 10, where=F.col("n_chars") > 100).select("query_id", "point_id").collect()
    allowed = {r[0] for r in col.points.where("n_chars > 100").select("point_id").collect()}
    assert got and all(r.point_id in allowed for r in got)


def test_sparse_search_shuffles_k_rows_a_query_and_task(spark):
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.sparse(col, qs, 10))
    assert "MapInArrow" in p and "HashAggregate" not in p and "/postings" not in p


def test_cascade_reads_no_postings_in_its_second_stage(spark):
    col, qs = corpus(spark, SF_SMALL)
    p = plan(S.multistep(col, qs, 10, prefetch_dense=25, prefetch_sparse=15))
    scans = [x for x in p.split("\n") if "FileScan" in x]
    assert not any("/postings" in x or "/blocks" in x for x in scans)
    assert any("terms" in x.split("ReadSchema:")[-1] for x in scans)


def test_only_buckets_with_a_candidate_are_read(spark):
    """Vectors and payload of points that no query chose can be missing altogether."""
    import os
    from hyrank.operators import retrieve
    from hyrank.plans.collection import copy_collection
    from hyrank.session import scratch_path
    col, qs = corpus(spark, SF_SMALL)
    col = copy_collection(spark, col, scratch_path(spark, "copied"))
    wanted = col.points.where("bucket = 3").select("point_id").limit(2)
    cands = spark.createDataFrame([(q, r[0]) for r in wanted.collect() for q in (0, 1)], "query_id long, point_id long")
    runs = lambda: (sorted(map(tuple, retrieve.late_rescore(cands, col.points, qs.queries, candidate_bound=4).collect())),
                    sorted(map(tuple, shape.project_hits(cands, col.points, ["headline"], hit_bound=4).collect())))
    want = runs()
    assert len(want[0]) == 4 and len(want[1]) == 4
    base = col.path.removeprefix("file:") + "/points"
    for d in os.listdir(base):
        if d.startswith("bucket=") and d != "bucket=3":
            for f in os.listdir(f"{base}/{d}"):
                with open(f"{base}/{d}/{f}", "wb") as out:
                    out.write(b"not parquet")
    assert runs() == want


def test_whole_lists_are_ranked_without_a_window_by_query(spark):
    from hyrank.operators import retrieve
    hits = spark.range(2000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("point_id"), ((F.col("id") * 7) % 50 / 10).alias("score"))
    hits = hits.where("query_id < 2 or point_id < 30").unionAll(spark.createDataFrame([(None, 1, 0.5), (None, 2, 0.7)], hits.schema))
    got = retrieve.rank_hits(hits, None)
    lists = [x for x in plan(got).split("\n") if "Window " in x]
    assert all("_part" in x for x in lists)                       # only the partitions' sizes are summed up
    want = retrieve.rank_hits(hits, None, bounded=True)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_cutoffs_in_runs_equal_one_running_sum(spark, monkeypatch):
    from hyrank.operators import evaluate
    rows = [(q, "m", r, (r * (q + 3)) % 5 == 0) for q, n in ((1, 999), (2, 50), (3, 49), (4, 1000)) for r in range(1, n + 1)]
    hits = spark.createDataFrame(rows, "query_id long, method string, rank long, relevant boolean")
    want = sorted((q, "m", c, sum(x[3] for x in rows if x[0] == q and x[2] <= c)) for q, n in ((1, 999), (2, 50), (4, 1000)) for c in range(50, n + 1, 50))
    for steps in (3, 1024):
        monkeypatch.setattr(evaluate, "STEPS", steps)
        assert sorted(tuple(r)[:4] for r in evaluate.hits_at_cutoffs(hits).collect()) == want


def test_a_collection_without_manifest_is_none(spark):
    import pytest
    from hyrank.plans.collection import open_collection
    from hyrank.session import scratch_path
    path = scratch_path(spark, "half")
    col, _ = corpus(spark, SF_SMALL)
    col.points.write.parquet(f"{path}/points")
    with pytest.raises(ValueError, match="manifest"):
        open_collection(spark, path)


def test_queries_of_another_dimension_raise_before_the_search(spark):
    import pytest
    from hyrank import api
    col, _ = corpus(spark, SF_SMALL)
    qs = api.build_query_set(spark, spark.createDataFrame([(1, "a b")], "query_id long, text string"), dense_dim=48)
    with pytest.raises(ValueError, match="dense_dim 48"):
        api.search(col, qs, "dense")
