"""The seven retrieval strategies, as compositions of the operators.

Prefetch trees (leaf = scorer:limit, root = scorer or RRF):

=================  ==========================================
dense              dense (optional score threshold)
sparse             sparse
late               late (MaxSim)
rrf_dense_sparse   RRF(dense:N, sparse:N)
rrf_all            RRF(dense:N, sparse:N, late:N)
rerank_late        late(union(dense:N, sparse:N))
multistep          late(sparse:N2(dense:N1))
=================  ==========================================

The payload filter (P4) is applied to the corpus feeding every branch,
before scoring: it is pushed into the scan of the points, and into that of the postings
where they carry the columns it asks for. The sparse branch without a filter skips
blocks by their largest weights (operators.blockmax); a cascade's sparse stage reads the
candidates' own term vectors, no postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyrank.operators import blockmax, fuse, ivf, retrieve
from hyrank.plans.collection import Collection, QuerySet, resolves
from hyrank.session import work_dir

# The searched system's defaults.
PAGE_SIZE = 10
PREFETCH = 1000
DENSE_THRESHOLD = 0.6


def _filtered(col: Collection, where: Column | None) -> DataFrame:
    """Points passing the payload filter (pushed to the scan)."""
    return col.points if where is None else col.points.where(where)


def _dense(col: Collection, qs: QuerySet, k: int | None, where: Column | None, threshold: float | None = None, ranked: bool = True) -> DataFrame:
    """The dense branch: exact, or by the collection's index where it has one and nothing narrows the points."""
    if col.index is not None and where is None and threshold is None and k is not None:
        return ivf.search(col.index, col.quantizer, col.points, qs.queries, k)
    return retrieve.dense_topk(_filtered(col, where), qs.queries, k, threshold, ranked=ranked)


def _sparse(col: Collection, qs: QuerySet, k: int | None, where: Column | None, ranked: bool = True) -> DataFrame:
    if where is None and col.blocks is not None:
        return blockmax.blockmax_topk(col.blocks, col.idf, qs.terms, k, col.manifest.get("n_blocks"), ranked=ranked)
    if where is None or resolves(col.postings, where):
        postings = col.postings if where is None else col.postings.where(where)
        return retrieve.sparse_topk(postings, col.idf, qs.terms, k, ranked=ranked)
    # a filter on payload that postings do not carry: applied to the scores before ranking
    return retrieve.sparse_topk(col.postings, col.idf, qs.terms, k, ranked=ranked,
                                allowed=_filtered(col, where).select("point_id"))


def dense(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, threshold: float | None = DENSE_THRESHOLD,
          where: Column | None = None, ranked: bool = True) -> DataFrame:
    """``ranked=False`` with no ``k``: the hits alone (to count them)."""
    return _dense(col, qs, k, where, threshold, ranked)


def sparse(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, where: Column | None = None, ranked: bool = True) -> DataFrame:
    return _sparse(col, qs, k, where, ranked)


def late(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, where: Column | None = None) -> DataFrame:
    pts = _filtered(col, where)
    return retrieve.late_topk(pts, qs.queries, k)


def rrf_dense_sparse(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, prefetch: int = PREFETCH,
                     where: Column | None = None) -> DataFrame:
    d = _dense(col, qs, prefetch, where)
    s = _sparse(col, qs, prefetch, where)
    return fuse.rrf([d, s], k)


def rrf_all(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, prefetch: int = PREFETCH,
            where: Column | None = None) -> DataFrame:
    pts = _filtered(col, where)
    d = _dense(col, qs, prefetch, where)
    s = _sparse(col, qs, prefetch, where)
    lt = retrieve.late_topk(pts, qs.queries, prefetch)
    return fuse.rrf([d, s, lt], k)


def rerank_late(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, prefetch: int = PREFETCH,
                where: Column | None = None) -> DataFrame:
    pts = _filtered(col, where)
    d = _dense(col, qs, prefetch, where)
    s = _sparse(col, qs, prefetch, where)
    cands = fuse.union_candidates([d, s])
    return fuse.rerank(cands, pts, qs.queries, k, candidate_bound=2 * prefetch * qs.n)


def multistep(col: Collection, qs: QuerySet, k: int | None = PAGE_SIZE, prefetch_dense: int = PREFETCH,
              prefetch_sparse: int = PREFETCH, where: Column | None = None) -> DataFrame:
    pts = _filtered(col, where)
    d = _dense(col, qs, prefetch_dense, where)
    s = blockmax.forward_topk(pts, col.idf, qs.terms, d, prefetch_sparse, prefetch_dense * qs.n)
    return fuse.rerank(s, pts, qs.queries, k, candidate_bound=prefetch_sparse * qs.n)


STRATEGIES = {
    "dense": dense,
    "sparse": sparse,
    "late": late,
    "rrf_dense_sparse": rrf_dense_sparse,
    "rrf_all": rrf_all,
    "rerank_late": rerank_late,
    "multistep": multistep,
}


def all_strategies(col: Collection, qs: QuerySet, depth: int = 200, prefetch: int = PREFETCH,
                   threshold: float | None = DENSE_THRESHOLD, where: Column | None = None) -> dict[str, DataFrame]:
    """The seven strategies down to ``depth`` (<= prefetch), sharing work.

    The three single-vector branches (dense, sparse, late top-``prefetch``)
    are computed once and checkpointed to the shared folder; every strategy
    is derived from them. The MaxSim rescoring of both candidate sets
    (rerank: dense ∪ sparse; cascade: sparse restricted to dense) is one
    pass over their union, minus the pairs the late prefetch already scored.
    Results equal the independent strategies.
    """
    assert depth <= prefetch
    work_dir(col.points.sparkSession)       # checkpoint() needs the shared folder
    pts = _filtered(col, where)
    d = _dense(col, qs, prefetch, where).checkpoint()
    s = _sparse(col, qs, prefetch, where).checkpoint()
    lt = retrieve.late_topk(pts, qs.queries, prefetch).checkpoint()
    cascade_s = blockmax.forward_topk(pts, col.idf, qs.terms, d, prefetch, prefetch * qs.n).checkpoint()
    rr_cands = fuse.union_candidates([d, s])
    both = fuse.union_candidates([rr_cands, cascade_s])
    # a pair's MaxSim does not depend on the candidate set: reuse the scores the
    # late prefetch already computed, rescore only the pairs it did not rank
    keys = ["query_id", "point_id"]
    known = lt.select(*keys, "score").join(both, keys, "left_semi")
    missing = both.join(lt.select(*keys), keys, "left_anti")
    rescored = known.unionByName(
        retrieve.late_rescore(missing, pts, qs.queries, candidate_bound=3 * prefetch * qs.n)).checkpoint()
    rerank_hits = retrieve.rank_hits(rescored.join(rr_cands, ["query_id", "point_id"], "left_semi"), depth)
    cascade_hits = retrieve.rank_hits(
        rescored.join(cascade_s.select("query_id", "point_id"), ["query_id", "point_id"], "left_semi"), depth)
    dense_hits = d.where(F.col("rank") <= depth)
    if threshold is not None:
        dense_hits = dense_hits.where(F.col("score") >= threshold)
    return {
        "dense": dense_hits,
        "sparse": s.where(F.col("rank") <= depth),
        "late": lt.where(F.col("rank") <= depth),
        "rrf_dense_sparse": fuse.rrf([d, s], depth),
        "rrf_all": fuse.rrf([d, s, lt], depth),
        "rerank_late": rerank_hits,
        "multistep": cascade_hits,
    }
