"""R2 with impact pruning: block-max postings, and the second stage of cascades by the points' own term vectors.

``blocks``: one row for each block of about ``BLOCK_POINTS`` points (runs of a bucket's points, or dealt by a hash of
the id): the block's point ids and, for each of its terms, the largest weight, the places of the points that
hold it and their weights. A row is a whole small inverted index, so any split of the files is a
valid unit of work and nothing is shuffled to search.

Search: the rows are unrolled into entries (block by block, a few MB at a time), and each task keeps
the k best points of every query. Before a block's postings are touched, the sum of its largest
weights bounds what a query can find in it; blocks below the query's k-th best score so far are
skipped. So queries x k rows a task are shuffled, whatever the number of matches. Where there are many
blocks, a first search of one in ``SEED_SHARE`` gives every task a lower bound to start with.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyrank.functions import sparse_kernels
from hyrank.operators import retrieve

BLOCK_POINTS = 512
SEED_SHARE = 64
SEED_BLOCKS = 4 * SEED_SHARE        # fewer blocks are searched at once
MAX_LITERAL_TERMS = 1000            # up to so many query terms filter entries in the scan's own stage

BLOCK_SCHEMA = ("block long, entries array<struct<term: string, top: double, places: array<int>, weights: array<double>, "
                "ids: array<long>>>")


def block_of(n_blocks: int):
    return F.pmod(F.xxhash64("point_id"), F.lit(n_blocks))


def build_blocks(postings: DataFrame, n_points: int, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Block-max postings (BLOCK_SCHEMA) of (point_id, term, weight) rows; one shuffle, a block is bounded."""
    n_blocks = max(1, math.ceil(n_points / block_points))
    src = postings.select(block_of(n_blocks).cast("long").alias("block"), "point_id", "term", "weight")
    src = src.repartition("block").sortWithinPartitions("block")
    return src.mapInArrow(sparse_kernels.build_blocks_kernel(), BLOCK_SCHEMA)


def point_blocks(points: DataFrame, block_points: int = BLOCK_POINTS) -> DataFrame:
    """Block-max postings of points as they lie: each task cuts its points into blocks, no posting is shuffled."""
    rows = points.select("point_id", "terms", "weights").where(F.size("terms") > 0)
    return rows.mapInArrow(sparse_kernels.point_blocks_kernel(block_points), BLOCK_SCHEMA)


def query_blocks(query_terms: DataFrame, idf: DataFrame, max_bytes: int = retrieve.MAX_QUERY_BYTES):
    """Weighted terms of the queries in blocks of bounded size (``QueryTerms``).

    The vocabulary is only probed: terms the corpus does not have drop out.
    """
    n = query_terms.count()
    pairs = retrieve.weighted_query_terms(query_terms, idf, n).select(
        "query_id", "term", (F.col("qweight") * F.col("idf")).alias("coef"))
    n_blocks = max(1, math.ceil(n * 48 / max_bytes))
    for part in retrieve._blocks(pairs, n_blocks):
        got = part.toPandas().sort_values(["query_id", "term"])
        if not len(got):
            continue
        qids, query = np.unique(got["query_id"].to_numpy(np.int64), return_inverse=True)
        terms, term = np.unique(got["term"].to_numpy(object), return_inverse=True)
        yield sparse_kernels.QueryTerms(qids, terms.tolist(), query, term, got["coef"].to_numpy(np.float64))


def _entries(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """One row an entry; of terms that no query asks for only the Arrow kernel's look-up is spared."""
    rows = blocks.select("block", F.explode("entries").alias("e")).select("block", "e.*")
    if len(terms) <= MAX_LITERAL_TERMS:
        rows = rows.where(F.col("term").isNull() | F.col("term").isin(terms))
    return rows


def blockmax_topk(blocks: DataFrame, idf: DataFrame, query_terms: DataFrame, k: int | None = 10, n_blocks: int | None = None,
                  max_query_bytes: int = retrieve.MAX_QUERY_BYTES, salt_buckets: int | None = None, ranked: bool = True) -> DataFrame:
    """R2: exact top-k of the IDF-weighted sums; equals ``retrieve.sparse_topk`` over the same postings.

    ``n_blocks`` (of the manifest) decides whether a first search seeds the bounds; it changes no row.
    """
    spark = blocks.sparkSession
    parts = []
    for asked in query_blocks(query_terms, idf, max_query_bytes):
        bc = spark.sparkContext.broadcast(asked)
        seed = None
        if k is not None and (n_blocks or 0) >= SEED_BLOCKS:
            seed = spark.sparkContext.broadcast(seed_bounds(blocks, bc, k))
        rows = _entries(blocks, asked.terms)
        parts.append(rows.mapInArrow(sparse_kernels.blockmax_kernel(bc, k, seed), retrieve.HIT_SCHEMA))
    hits = retrieve._union(parts, retrieve.HIT_SCHEMA, spark)
    if k is None and not ranked:
        return hits
    salt = salt_buckets if salt_buckets is not None else retrieve.auto_salt(retrieve.scan_partitions(blocks))
    return retrieve.rank_hits(hits, k, salt)


def seed_bounds(blocks: DataFrame, bc, k: int) -> np.ndarray:
    """Each query's k-th best score among one block in SEED_SHARE: no point below it is among the k best of all."""
    asked = bc.value
    some = _entries(blocks.where(F.col("block") % SEED_SHARE == 0), asked.terms)
    hits = some.mapInArrow(sparse_kernels.blockmax_kernel(bc, k), retrieve.HIT_SCHEMA)
    last = retrieve.rank_hits(hits, k).where(F.col("rank") == k).select("query_id", "score").toPandas()   # a row a query
    out = np.full(len(asked.qids), -np.inf)
    out[np.searchsorted(asked.qids, last["query_id"].to_numpy(np.int64))] = last["score"].to_numpy()
    return out


def forward_vectors(postings: DataFrame) -> DataFrame:
    """(point_id, terms, weights): each point's sparse vector, terms ascending."""
    per = postings.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("v"))
    return per.select("point_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))


def forward_topk(points: DataFrame, idf: DataFrame, query_terms: DataFrame, candidates: DataFrame, k: int | None = 10,
                 candidate_bound: int | None = None, max_query_bytes: int = retrieve.MAX_QUERY_BYTES) -> DataFrame:
    """R7's second stage: the sparse score of given (query_id, point_id) pairs, from the points' own
    ``terms`` and ``weights``; no postings are read, and a point crosses into Python once."""
    spark = points.sparkSession
    rows = retrieve.candidate_rows(candidates, points, ["terms", "weights"], candidate_bound).where(F.size("terms") > 0)
    parts = []
    for asked in query_blocks(query_terms, idf, max_query_bytes):
        bc = spark.sparkContext.broadcast(asked)
        parts.append(rows.mapInArrow(sparse_kernels.sparse_pair_kernel(bc, k), retrieve.HIT_SCHEMA))
    return retrieve.rank_hits(retrieve._union(parts, retrieve.HIT_SCHEMA, spark), k)
