"""Operators on hand-made DataFrames: toy cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyrank.operators import fuse, represent, retrieve
from hyrank.sources import collection_ops as CO


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, point_id long, score double, rank long")


def test_rrf_point_in_one_branch_only(spark):
    a = hits(spark, [(1, 10, 0.9, 1), (1, 11, 0.8, 2)])
    b = hits(spark, [(1, 11, 5.0, 1), (1, 12, 4.0, 2)])
    out = {r.point_id: r.score for r in fuse.rrf([a, b], None).collect()}
    assert out == {10: round(1 / 2, 6), 11: round(1 / 3 + 1 / 2, 6), 12: round(1 / 3, 6)}


def test_rrf_invariant_to_branch_order(spark):
    rng = np.random.default_rng(5)
    rows_a = [(q, int(p), 0.0, r + 1) for q in range(3) for r, p in enumerate(rng.permutation(30)[:12])]
    rows_b = [(q, int(p), 0.0, r + 1) for q in range(3) for r, p in enumerate(rng.permutation(30)[:15])]
    a, b = hits(spark, rows_a), hits(spark, rows_b)
    x = sorted(map(tuple, fuse.rrf([a, b], 10).collect()))
    y = sorted(map(tuple, fuse.rrf([b, a], 10).collect()))
    assert x == y


def _unit(v):
    v = np.asarray(v, float)
    return (v / np.linalg.norm(v)).tolist()


def test_dense_threshold_boundary_and_empty(spark):
    pts = spark.createDataFrame([(1, [1.0, 0.0]), (2, _unit([0.6, 0.8])), (3, [0.0, 1.0]), (4, None)],
                                "point_id long, dense array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, dense array<double>")
    got = {r.point_id: r.score for r in retrieve.dense_topk(pts, q, 10, threshold=0.6).collect()}
    assert got == {1: 1.0, 2: 0.6}          # 0.6 is kept, 0 is not, null vector ignored
    none = retrieve.dense_topk(pts, q, 10, threshold=1.5).collect()
    assert none == []


def test_rank_is_permutation_and_salted_equals_plain(spark):
    rng = np.random.default_rng(6)
    rows = [(int(q), int(p), float(np.round(rng.random(), 2))) for q in range(4) for p in range(300)]
    cand = spark.createDataFrame(rows, "query_id long, point_id long, score double")
    plain = retrieve.rank_hits(cand, 25)
    salted = retrieve.rank_hits(cand, 25, salt_buckets=7)
    a = sorted(map(tuple, plain.collect()))
    b = sorted(map(tuple, salted.collect()))
    assert a == b
    for q in range(4):
        ranks = sorted(x[3] for x in a if x[0] == q)
        assert ranks == list(range(1, 26))


def test_page_past_end_is_empty(spark):
    h = hits(spark, [(1, p, 1.0 / p, p) for p in range(1, 24)])
    assert retrieve.page_hits(h, 2, 10).count() == 3
    assert retrieve.page_hits(h, 3, 10).count() == 0


def test_sparse_only_shared_terms_score(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "green tree")],
                                 "point_id long, text string")
    post = represent.bm25_weights(docs)
    idf = represent.idf_table(post)
    qs = spark.createDataFrame([(9, "fish fish"), (8, "nothing matches")], "item_id long, text string")
    _, terms = represent.build_queries(qs)
    out = retrieve.sparse_topk(post, idf, terms, 10).collect()
    assert {(r.query_id, r.point_id) for r in out} == {(9, 1), (9, 2)}
    s = {r.point_id: r.score for r in out}
    assert s[2] > s[1]


def test_upsert_idempotent_and_last_write_wins(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "point_id long, source string, seq long")
    upd = spark.createDataFrame([(2, "b2", 2), (2, "b3", 3), (4, "d", 2)], "point_id long, source string, seq long")
    once = CO.upsert_points(target, upd)
    twice = CO.upsert_points(once, upd)
    want = [(1, "a", 1), (2, "b3", 3), (3, "c", 1), (4, "d", 2)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, twice.collect())) == want


def test_validate_vectors_rejects_bad_rows(spark):
    pts = spark.createDataFrame(
        [(1, [1.0, 0.0], [[1.0, 0.0]]), (2, [1.0], [[1.0, 0.0]]), (3, [0.0, 0.0], None),
         (4, None, [[1.0, 0.0], [1.0]]), (5, None, None)],
        "point_id long, dense array<double>, late array<array<double>>")
    valid, rejected = CO.validate_vectors(pts, 2, 2)
    assert sorted(r.point_id for r in valid.collect()) == [1, 5]
    assert {r.point_id: r.reason for r in rejected.collect()} == {2: "dense_dim", 3: "dense_zero", 4: "late_dim"}


def test_null_text_and_empty_tokens_give_partial_points(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "!!! ...", "y"), (3, "hello world", "z")],
                                 "doc_id long, text string, src string")
    pts, post = represent.build_points(docs, payload=["src"])
    rows = {r.point_id: r for r in pts.collect()}
    assert rows[1].dense is None and rows[1].late is None
    assert rows[2].dense is None and rows[2].late is None
    assert len(rows[3].dense) == represent.DENSE_DIM and len(rows[3].late) == 2
    assert sorted(r.point_id for r in post.collect()) == [3, 3]


def test_late_rerank_subset_of_candidates(spark):
    rng = np.random.default_rng(8)
    pts = spark.createDataFrame(
        [(i, [_unit(rng.standard_normal(4)) for _ in range(int(rng.integers(1, 5)))]) for i in range(30)],
        "point_id long, late array<array<double>>")
    qs = spark.createDataFrame([(1, [_unit(rng.standard_normal(4)) for _ in range(3)])],
                               "query_id long, late array<array<double>>")
    cands = spark.createDataFrame([(1, p) for p in range(0, 30, 3)], "query_id long, point_id long")
    out = fuse.rerank(cands, pts, qs, k=None, candidate_bound=10).collect()
    assert {r.point_id for r in out} == set(range(0, 30, 3))
    full = {r.point_id: r.score for r in retrieve.late_topk(pts, qs, None).collect()}
    for r in out:
        assert r.score == pytest.approx(full[r.point_id], abs=1e-9)


def test_query_blocks_give_same_hits(spark):
    rng = np.random.default_rng(11)
    pts = spark.createDataFrame([(i, _unit(rng.standard_normal(8))) for i in range(200)],
                                "point_id long, dense array<double>")
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    one = sorted(map(tuple, retrieve.dense_topk(pts, q, 5).collect()))
    blocks = sorted(map(tuple, retrieve.dense_topk(pts, q, 5, max_query_bytes=2048).collect()))
    assert one == blocks and len(one) == 1000
    assert retrieve._n_blocks(q, F.size("dense"), 2048) > 1


def test_block_pairs_fetch_nothing_and_give_same_hits(spark, monkeypatch):
    rng = np.random.default_rng(12)
    pts = spark.createDataFrame([(i, _unit(rng.standard_normal(8))) for i in range(200)] + [(999, None)], "point_id long, dense array<double>")
    q = pts.select(F.col("point_id").alias("query_id"), "dense")
    want = sorted(map(tuple, retrieve.dense_topk(pts, q, 5).collect()))
    monkeypatch.setattr(type(pts), "toArrow", None)
    few, many = (retrieve.dense_topk_blocks(pts, q, 5, block_bytes=n) for n in (8192, 1024))
    assert sorted(map(tuple, many.collect())) == want
    lines = [len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()) for df in (few, many)]
    assert lines[0] == lines[1]


def test_bounded_broadcast_falls_back_to_shuffle(spark):
    small = spark.range(10)
    assert "ResolvedHint" in small.hint("broadcast")._jdf.queryExecution().analyzed().toString()
    kept = retrieve.bounded_broadcast(small, bound=10, max_rows=5)
    assert "broadcast" not in kept._jdf.queryExecution().analyzed().toString().lower()
    hinted = retrieve.bounded_broadcast(small, bound=3, max_rows=5)
    assert "broadcast" in hinted._jdf.queryExecution().analyzed().toString().lower()


def test_hot_term_sparse_salted_equals_plain(spark):
    """A term in every document (a third of all postings and more): salted
    two-level ranking gives the same exact top-k as the single level."""
    rows = [(i, "common " + " ".join(f"w{(i * 7 + j) % 23}" for j in range(i % 5 + 1))) for i in range(300)]
    docs = spark.createDataFrame(rows, "point_id long, text string")
    post = represent.bm25_weights(docs)
    idf = represent.idf_table(post)
    qs = spark.createDataFrame([(1, "common w3 w5"), (2, "common")], "item_id long, text string")
    _, terms = represent.build_queries(qs)
    plain = sorted(map(tuple, retrieve.sparse_topk(post, idf, terms, 20, salt_buckets=1).collect()))
    salted = sorted(map(tuple, retrieve.sparse_topk(post, idf, terms, 20, salt_buckets=9).collect()))
    assert plain == salted and len(plain) == 40


def test_hot_key_upsert_dedup(spark):
    """One key updated many times in a batch reduces to its latest version."""
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "point_id long, source string, seq long")
    upd = spark.range(2, 502).select(F.lit(1).cast("long").alias("point_id"),
                                     F.concat(F.lit("v"), F.col("id").cast("string")).alias("source"),
                                     F.col("id").alias("seq"))
    got = sorted(map(tuple, CO.upsert_points(target, upd).collect()))
    assert got == [(1, "v501", 501), (2, "b", 1)]


def test_public_api_roundtrip(spark):
    from hyrank import api
    docs = spark.createDataFrame(
        [(1, "quality engineering and test automation", "en"), (2, "regression testing tools", "en"),
         (3, "la cuisine française", "fr"), (4, "test automation strategy", "en")],
        "doc_id long, text string, lang string")
    col = api.build_collection(spark, docs, payload=["lang"])
    qs = api.build_query_set(spark, spark.createDataFrame([(7, "test automation")], "query_id long, text string"))
    for m in api.METHODS:
        hits = api.search(col, qs, m, k=3, where=F.col("lang") == "en", payload=["lang"], **(
            {"threshold": None} if m == "dense" else {}))
        rows = hits.collect()
        assert rows and all(r.lang == "en" for r in rows), m
    top = api.search(col, qs, "sparse", k=10).orderBy("rank").collect()
    assert {top[0].point_id, top[1].point_id} == {1, 4}
    assert api.page(api.search(col, qs, "sparse", k=None), 1, 2).count() == 0


def test_collection_from_external_vectors(spark):
    from hyrank import api
    from hyrank.plans.collection import QuerySet
    pts = spark.createDataFrame(
        [(1, [3.0, 4.0], [[1.0, 0.0], [0.0, 2.0]], "red fish"),
         (2, [1.0, 0.0, 0.0], [[1.0, 0.0]], "blue fish"),          # wrong dense dimension
         (3, [0.0, 5.0], [[0.0, 1.0]], "green fish")],
        "point_id long, dense array<double>, late array<array<double>>, text string")
    col, rejected = api.build_collection_from_vectors(spark, pts, 2, 2, text_col="text")
    assert [(r.point_id, r.reason) for r in rejected.collect()] == [(2, "dense_dim")]
    dense = {r.point_id: r.dense for r in col.points.collect()}
    assert sorted(dense) == [1, 3] and dense[1] == pytest.approx([0.6, 0.8], abs=1e-6)
    q = spark.createDataFrame([(9, [0.0, 1.0], [[0.0, 1.0]])], "query_id long, dense array<double>, late array<array<double>>")
    terms = spark.createDataFrame([(9, "fish", 1.0)], "query_id long, term string, qweight double")
    qs = QuerySet(q, terms, 1)
    top = api.search(col, qs, "dense", k=1, threshold=None).collect()
    assert top[0].point_id == 3 and top[0].score == pytest.approx(1.0)
    assert {r.point_id for r in api.search(col, qs, "sparse", k=5).collect()} == {1, 3}


def test_cursor_pages_follow_one_another_to_the_end(spark):
    """Ties across the edge of a page, copies of a score, and the empty page behind the last hit."""
    pts = spark.createDataFrame([(i, [float((i * 7) % 5) / 5, 1.0]) for i in range(23)], "point_id long, dense array<double>")
    qs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, dense array<double>")
    whole = retrieve.dense_topk(pts, qs, 23).select("query_id", "point_id", "score").collect()
    want = {q: [(r.point_id, r.score) for r in whole if r.query_id == q] for q in (1, 2)}
    got, cursor = {1: [], 2: []}, None
    for _ in range(5):
        page = retrieve.dense_page(pts, qs, 6, cursor)
        rows = sorted(page.collect(), key=lambda r: (r.query_id, r["rank"]))
        for r in rows:
            got[r.query_id].append((r.point_id, r.score))
        cursor = retrieve.cursor_of(spark.createDataFrame(rows, page.schema))
    order = lambda hits: sorted(hits, key=lambda h: (-h[1], h[0]))
    assert got == {q: order(h) for q, h in want.items()}
