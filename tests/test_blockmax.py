"""Block-max postings and forward vectors against the plain sparse search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hyrank.functions import sparse_kernels as SK
from hyrank.operators import blockmax, represent, retrieve


def corpus(spark, n=3000):
    """Skewed terms: one in every document, some frequent, many rare; long and short documents."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        own = words[:1] + [words[int(j)] for j in np.minimum(399, rng.zipf(1.3, rng.integers(0, 40)))]
        docs.append((i, " ".join(own)))
    docs += [(n + i, "twin twin w1") for i in range(50)] + [(n + 100, None), (n + 101, ""), (n + 102, "!!!")]
    return spark.createDataFrame(docs, "point_id long, text string")


@pytest.fixture(scope="module")
def parts(spark):
    post = represent.bm25_weights(corpus(spark)).cache()
    idf = represent.idf_table(post).cache()
    rng = np.random.default_rng(9)
    qs = [(q, " ".join(f"w{int(j)}" for j in rng.integers(0, 60, rng.integers(1, 9)))) for q in range(40)]
    qs += [(100, "twin"), (101, "w0"), (102, "absent words only"), (103, "twin w399 w398")]
    _, terms = represent.build_queries(spark.createDataFrame(qs, "item_id long, text string"))
    return post, idf, terms.cache()


def as_rows(df):
    return sorted((r.query_id, r["rank"], r.point_id, r.score) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 200, None])
@pytest.mark.parametrize("size", [64, 512])
def test_blockmax_equals_the_plain_search(spark, parts, k, size):
    post, idf, terms = parts
    blocks = blockmax.build_blocks(post, post.select("point_id").distinct().count(), size)
    assert as_rows(blockmax.blockmax_topk(blocks, idf, terms, k)) == as_rows(retrieve.sparse_topk(post, idf, terms, k))


def test_seeded_bounds_and_query_blocks_change_nothing(spark, parts, monkeypatch):
    post, idf, terms = parts
    blocks = blockmax.build_blocks(post, 3050, 8).cache()
    want = as_rows(retrieve.sparse_topk(post, idf, terms, 10))
    monkeypatch.setattr(blockmax, "SEED_BLOCKS", 1)
    monkeypatch.setattr(blockmax, "SEED_SHARE", 8)
    assert as_rows(blockmax.blockmax_topk(blocks, idf, terms, 10, n_blocks=400)) == want
    monkeypatch.setattr(blockmax, "MAX_LITERAL_TERMS", 0)
    assert as_rows(blockmax.blockmax_topk(blocks, idf, terms, 10, max_query_bytes=1000)) == want


def test_each_point_lies_in_one_block(spark, parts):
    post, _, _ = parts
    blocks = blockmax.build_blocks(post, 3050, 64)
    e = blocks.select("block", F.explode("entries").alias("e")).select("block", "e.*")
    ids = e.where("term is null").select(F.explode("ids").alias("point_id"))
    assert sorted(r[0] for r in ids.collect()) == sorted(r[0] for r in post.select("point_id").distinct().collect())
    top = e.where("term is not null").where(F.array_max("weights") != F.col("top"))
    assert top.isEmpty()


class _BC:
    def __init__(self, value):
        self.value = value


def test_blocks_below_the_bound_are_never_decoded():
    """40 blocks, the best ones first: the rest are left alone."""
    rng = np.random.default_rng(0)
    batches, best = [], []
    for block in range(40):
        ids = np.arange(block * 100, block * 100 + 100)
        weights = rng.random(100) * (1.0 if block == 0 else 0.4)
        entries = SK.block_entries(ids, pa.array(["t"] * 100), weights)
        best += list(zip(weights, ids))
        flat = {name: entries.field(i) for i, name in enumerate(("term", "top", "places", "weights", "ids"))}
        batches.append(pa.RecordBatch.from_pydict({"block": pa.array([block] * len(entries)), **flat}))
    stats = {}
    asked = SK.QueryTerms(np.array([7, 8]), ["t", "u"], np.array([0, 1]), np.array([0, 1]), np.array([2.0, 1.0]))
    got = pa.Table.from_batches(list(SK.blockmax_kernel(_BC(asked), 5, stats=stats)(iter(batches))))
    want = sorted(((round(2 * w, 6), -i) for w, i in best), reverse=True)[:5]
    assert sorted(zip(got["score"].to_pylist(), (-i for i in got["point_id"].to_pylist())), reverse=True) == want
    assert stats == {"pairs": 40, "scored": 1, "decoded": 1}
    assert got.num_rows == 5                        # k rows a query leave a task, not one a match


def test_forward_vectors_score_given_pairs_like_postings(spark, parts):
    post, idf, terms = parts
    cands = spark.range(0, 3100, 3).select(F.col("id").alias("point_id")).crossJoin(
        terms.select("query_id").distinct().where("query_id % 3 != 1"))
    points = blockmax.forward_vectors(post)
    for k in (5, None):
        got = blockmax.forward_topk(points, idf, terms, cands, k)
        assert as_rows(got) == as_rows(retrieve.sparse_topk(post, idf, terms, k, candidates=cands))


def test_sparse_vectors_in_the_row_equal_postings(spark):
    docs = spark.createDataFrame([(1, "b a b c"), (2, None), (3, ""), (4, "x"), (5, "Äpfel äpfel 7 7 7")], "point_id long, text string")
    want = sorted(map(tuple, represent.bm25_weights(docs).collect()))
    assert sorted(map(tuple, represent.exploded(represent.with_sparse(docs, "point_id", "text")).collect())) == want
    points, postings = represent.build_points(docs.withColumnRenamed("point_id", "doc_id"))
    assert sorted(map(tuple, postings.collect())) == want


def test_empty_collection(spark):
    post = represent.bm25_weights(spark.createDataFrame([], "point_id long, text string"))
    idf = represent.idf_table(post)
    blocks = blockmax.build_blocks(post, 0)
    _, terms = represent.build_queries(spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert blockmax.blockmax_topk(blocks, idf, terms, 10).count() == 0
