"""Fusion and multi-stage retrieval.

A prefetch tree (leaf = scorer + limit, inner node = scorer over its
children's candidates, root = scorer or RRF) is ordinary function
composition over hit DataFrames ``(query_id, point_id, score, rank)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyrank.functions import kernels
from hyrank.functions.text import RRF_C, RRF_RANK_BASE
from hyrank.operators.retrieve import rank_hits


def rrf(branches: list[DataFrame], k: int | None = 10, c: float = RRF_C,
        rank_base: int = RRF_RANK_BASE) -> DataFrame:
    """Reciprocal rank fusion.

    score = sum over branches of 1 / (c + rank'), rank' counted from
    ``rank_base`` (0 by default; the RRF paper uses c=60 and base 1). A
    point found by one branch only still scores. Branch order is irrelevant.
    The branches are prefetches, so a fused list is bounded by the sum of their limits.
    """
    contrib = None
    for b in branches:
        part = b.select("query_id", "point_id",
                        (F.lit(1.0) / (F.lit(float(c)) + (F.col("rank") - 1 + rank_base))).alias("_c"))
        contrib = part if contrib is None else contrib.unionByName(part)
    fused = contrib.groupBy("query_id", "point_id").agg(
        (F.round(F.sum("_c"), kernels.SCORE_DECIMALS) + 0.0).alias("score"))
    return rank_hits(fused, k, bounded=True)


def union_candidates(branches: list[DataFrame]) -> DataFrame:
    """Each (query, point) once, whatever branch found it."""
    out = None
    for b in branches:
        part = b.select("query_id", "point_id")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def rerank(candidates: DataFrame, points: DataFrame, queries: DataFrame, k: int | None = 10,
           candidate_bound: int | None = None, vec_col: str = "late") -> DataFrame:
    """Rescore candidates with MaxSim; prefetch scores are discarded. Lists are bounded by the prefetches."""
    from hyrank.operators.retrieve import late_rescore
    scored = late_rescore(candidates, points, queries, vec_col, candidate_bound=candidate_bound, k=k)
    return rank_hits(scored, k, bounded=True)
