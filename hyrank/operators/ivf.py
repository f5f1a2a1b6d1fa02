"""R11 as an inverted-file index with product-quantised residuals, and exact rerank.

Build: k-means centroids (``lists`` = about the root of N times 2, fitted on a bounded sample: ``FIT_PER_LIST``
vectors a list, ``MAX_FIT`` at most) cut the vectors into lists; each vector is stored in its
list with the code of its residual: ``PARTS`` sub-vectors, each the nearest of ``CODES`` centres. Lists are
directories, so a search reads those it probes.

Search: a query probes the ``probes`` nearest lists. It scores the vectors that their codes stand for (asymmetric
distances: no stored vector is read), and the best ``keep`` are scored exactly on the stored vectors. Only centroids and centres (fixed sizes) are
broadcast. Probes are fitted: the fewest, in powers of two, whose recall of ``k`` reaches ``target`` on a sample of
vectors against the sample's own exact neighbours.

A list that holds many vectors is dealt over several files (``LIST_ROWS``). The number of lists grows as the root of N, so a query meets a share of the vectors that falls as N grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyrank.functions import kernels
from hyrank.operators import retrieve
from hyrank.session import scratch_path

FIT_PER_LIST = 64
MAX_FIT = 100_000
FIT_QUERIES = 200
PARTS, CODES = 8, 256
LIST_ROWS = 100_000
FEW_QUERIES = 1000          # so many queries look up the lists they probe on the driver, to read only those
TARGET = 0.95


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres of a sample that fits in memory; an empty one moves to the vector farthest from its own."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[np.argsort(-far)[:len(empty)]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, tile: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of each vector's nearest centre."""
    own, far = np.empty(len(x), np.int64), np.empty(len(x))
    half = (centres ** 2).sum(axis=1) / 2
    for lo in range(0, len(x), tile):
        part = x[lo:lo + tile]
        score = part @ centres.T - half
        own[lo:lo + tile] = score.argmax(axis=1)
        far[lo:lo + tile] = (part ** 2).sum(axis=1) - 2 * score.max(axis=1)
    return own, far


class Quantizer:
    """Centroids of the lists and centres of the residuals' parts; a few MB, whatever the corpus."""

    def __init__(self, centroids: np.ndarray, centres: list[np.ndarray], probes: int = 1, keep: int = 100):
        self.centroids, self.centres, self.probes, self.keep = centroids, centres, probes, keep
        self.edges = np.cumsum([0, *(c.shape[1] for c in centres)])

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, _ = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        return own, np.stack([nearest(rest[:, a:b], c)[0] for a, b, c in zip(self.edges, self.edges[1:], self.centres)], axis=1).astype(np.uint8)

    def probed(self, queries: np.ndarray, probes: int | None = None) -> np.ndarray:
        """(queries, probes): lists by their centroid's product with the query."""
        n = min(probes or self.probes, len(self.centroids))
        score = queries @ self.centroids.T
        return np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(queries), 1))

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts, codes): products of each query's parts with all centres."""
        out = np.full((len(queries), len(self.centres), CODES), -np.inf)
        for p, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.centres)):
            out[:, p, :len(c)] = queries[:, a:b] @ c.T
        return out


def fit(points: DataFrame, vec_col: str = "dense", k: int = 10, target: float = TARGET, lists: int | None = None) -> Quantizer:
    """A quantizer from a bounded sample (lowest hash of the id first), with probes fitted to ``target``."""
    src = points.select("point_id", vec_col).where(F.col(vec_col).isNotNull())
    n = src.count()
    lists = lists or max(1, int(2 * math.sqrt(n)))
    bound = min(MAX_FIT, lists * FIT_PER_LIST)
    got = src.orderBy(F.xxhash64("point_id"), "point_id").limit(bound).select(vec_col).toArrow()      # MAX_FIT vectors at most
    if not got.num_rows:
        return Quantizer(np.zeros((1, 1)), [np.zeros((1, 1))])
    _, x = kernels._flat_vectors(got.column(0).combine_chunks(), len(got.column(0)[0]))
    x = np.asarray(x, np.float64)
    centroids = kmeans(x, min(lists, len(x)))
    rest = x - centroids[nearest(x, centroids)[0]]
    edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int)
    q = Quantizer(centroids, [kmeans(rest[:, a:b], CODES, seed=11) for a, b in zip(edges, edges[1:])], keep=10 * k)
    return fitted(q, x, k, target)


def fitted(q: Quantizer, x: np.ndarray, k: int, target: float) -> Quantizer:
    """Fewest probes and kept candidates, in powers of two, that find ``target`` of the sample's neighbours."""
    asks = x[:FIT_QUERIES]
    exact = x @ asks.T
    want = np.argpartition(-exact, min(k, len(x) - 1), axis=0)[:k]
    own, codes = q.codes(x)
    table = q.tables(asks)
    order = np.argsort(-(asks @ q.centroids.T), axis=1)
    approx = (asks @ q.centroids.T)[:, own] + sum(table[:, p][:, codes[:, p]] for p in range(codes.shape[1]))

    def recall(probes, keep):
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None].repeat(len(order), 0), axis=1)
        seen = np.where(rank[:, own] < probes, approx, -np.inf)
        kept = np.argpartition(-seen, min(keep, len(x) - 1), axis=1)[:, :keep]
        hit = sum(len(set(want[:, i]) & set(kept[i][np.isfinite(seen[i, kept[i]])])) for i in range(len(asks)))
        return hit / want.size

    q.keep, q.probes = 10 * k, 1
    while q.keep < len(x) and recall(len(q.centroids), q.keep) < target + (1 - target) / 2:
        q.keep *= 2
    while q.probes < len(q.centroids) and recall(q.probes, q.keep) < target:
        q.probes *= 2
    return q


INDEX = "point_id long, list int, slice int, code binary"


def build(points: DataFrame, q: Quantizer, vec_col: str = "dense", path: str | None = None) -> DataFrame:
    """The index, written in directories ``list=``: (point_id, slice, code) of every vector."""
    spark = points.sparkSession
    bc = spark.sparkContext.broadcast(q)

    def run(batches):
        quantizer = bc.value
        for b in batches:
            rows, x = kernels._flat_vectors(b.column(vec_col), quantizer.centroids.shape[1])
            if len(rows):
                own, codes = quantizer.codes(x)
                ids = b.column("point_id").take(pa.array(rows))
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.astype(np.int32)), pa.array(np.zeros(len(rows), np.int32)), raw.cast(pa.binary())],
                                                 names=["point_id", "list", "slice", "code"])

    path = path or scratch_path(spark, "ivf")
    coded = points.select("point_id", vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(run, INDEX)
    n = points.count()
    slices = max(1, math.ceil(n / LIST_ROWS))                     # a list of all vectors would still be cut to LIST_ROWS
    coded = coded.withColumn("slice", F.pmod(F.xxhash64("point_id"), F.lit(slices)).cast("int"))
    coded.repartition("list", "slice").sortWithinPartitions("list", "slice").write.partitionBy("list").parquet(path)
    return spark.read.schema("point_id long, slice int, code binary, list int").parquet(path)


QUERY_PART = 64 << 20       # bytes of kept candidates that one task holds


def search(index: DataFrame, q: Quantizer, points: DataFrame, queries: DataFrame, k: int = 10, vec_col: str = "dense",
           probes: int | None = None, max_query_bytes: int = retrieve.MAX_QUERY_BYTES) -> DataFrame:
    """Top-k hits, exact scores. Queries are dealt into parts whose kept candidates take QUERY_PART at most; each
    part meets the lists that one of its queries probes in one task, codes only (a few bytes a vector). Few queries read
    only the directories they probe."""
    spark = points.sparkSession
    bcq = spark.sparkContext.broadcast(q)
    keep = max(q.keep, k)
    asks = queries.select(F.col("query_id").alias("id"), F.col(vec_col).alias("v")).where(F.col(vec_col).isNotNull() & F.col("query_id").isNotNull())
    n_queries = asks.count()
    if n_queries <= FEW_QUERIES:
        few = asks.toArrow()                                      # FEW_QUERIES vectors at most
        if n_queries:
            _, mat = kernels._flat_vectors(few.column("v").combine_chunks(), q.centroids.shape[1])
            wanted = np.unique(q.probed(mat, probes)).tolist()    # at most the number of lists
            index = index.where(F.col("list").isin(wanted)) if len(wanted) < len(q.centroids) else index
    width = max(1, math.ceil(n_queries * keep * 64 / QUERY_PART))
    # one part a core when there are many queries: the index is sent to each
    parts = max(width, min(2 * spark.sparkContext.defaultParallelism, math.ceil(n_queries / FEW_QUERIES)))
    none = F.lit(None)
    asked = asks.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(-1).alias("list"), "id", "v", none.cast("binary").alias("code"))
    coded = index.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "list", F.col("point_id").alias("id"),
                         none.cast(asks.schema["v"].dataType).alias("v"), "code")
    both = asked.unionByName(coded).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "list")
    near = retrieve.rank_hits(both.mapInArrow(_scan(bcq, keep, probes), retrieve.HIT_SCHEMA), keep)
    return rescored(near, points, queries, k, vec_col, n_queries * keep, max_query_bytes)


def decoded(q: Quantizer, own: int, codes: np.ndarray) -> np.ndarray:
    """The vectors that codes of a list stand for; a query's product with them is the sum of its table's entries."""
    return q.centroids[own] + np.concatenate([c[codes[:, p]] for p, c in enumerate(q.centres)], axis=1)


def _scan(bcq, keep, probes):
    """Rows (part, list, id, v, code), queries (list -1) first, then codes list by list -> best ``keep`` of each query."""
    def run(batches):
        quantizer = bcq.value
        dim, width = quantizer.centroids.shape[1], len(quantizer.centres)
        ids, mats, buf = [], [], None
        for b in batches:
            own = b.column("list").to_numpy(zero_copy_only=False)
            all_ids = b.column("id").to_numpy(zero_copy_only=False)
            lead = int(np.searchsorted(own, 0))                   # sorted: queries before codes
            if lead:
                ids.append(all_ids[:lead])
                mats.append(kernels._flat_vectors(b.column("v").slice(0, lead), dim)[1])
            if lead == b.num_rows or not ids:
                continue
            if buf is None:
                qids, mat = np.concatenate(ids).astype(np.int64), np.concatenate(mats)
                buf = kernels.TopKBuffer(qids, keep)
                lists = np.concatenate([quantizer.probed(mat[lo:lo + 4096], probes) for lo in range(0, len(mat), 4096)])
                order = np.argsort(lists, axis=None, kind="stable")
                asks = order // lists.shape[1]
                edge = np.searchsorted(lists.ravel()[order], np.arange(len(quantizer.centroids) + 1))
            raw = b.column("code").slice(lead).cast(pa.binary(width))
            codes = np.frombuffer(raw.buffers()[1], np.uint8)[raw.offset * width:(raw.offset + len(raw)) * width].reshape(-1, width)
            own, pids = own[lead:], all_ids[lead:]
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                c = int(own[lo])
                mine = asks[edge[c]:edge[c + 1]]
                if not len(mine):
                    continue
                x = decoded(quantizer, c, codes[lo:hi])
                for at in range(0, len(mine), kernels.QBLOCK):
                    some = mine[at:at + kernels.QBLOCK]
                    for qi, score in zip(some.tolist(), mat[some] @ x.T):
                        low = buf.bound(qi)
                        hit = np.flatnonzero(score >= low) if low > -np.inf else slice(None)
                        buf.add(qi, pids[lo:hi][hit], score[hit])
        out = buf.batch() if buf is not None else None
        if out is not None:
            yield out
    return run


PAIRS = 1 << 16             # pairs scored at once


def rescored(near: DataFrame, points: DataFrame, queries: DataFrame, k: int, vec_col: str, bound: int,
             max_query_bytes: int = retrieve.MAX_QUERY_BYTES) -> DataFrame:
    """Exact products of the kept pairs; vectors of other points are not shuffled."""
    spark = points.sparkSession
    rows = retrieve.candidate_rows(near, points, [vec_col], bound)
    parts = []
    for qids, mat in retrieve.dense_query_blocks(queries, vec_col, max_query_bytes):
        bc = spark.sparkContext.broadcast((qids, mat))

        def run(batches, bc=bc):
            qids, mat = bc.value                                  # sorted by id
            for b in batches:
                at, x = kernels._flat_vectors(b.column(vec_col), mat.shape[1])
                asks = b.column("qids").take(pa.array(at))
                n = asks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                asked = asks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                pair_q = np.clip(np.searchsorted(qids, asked, "right") - 1, 0, len(qids) - 1)
                pair_r = np.repeat(np.arange(len(at)), n)
                known = qids[pair_q] == asked
                pair_q, pair_r = pair_q[known], pair_r[known]
                ids = b.column("point_id").to_numpy(zero_copy_only=False)[at]
                for lo in range(0, len(pair_q), PAIRS):
                    pq, pr = pair_q[lo:lo + PAIRS], pair_r[lo:lo + PAIRS]
                    score = kernels.round_scores(np.einsum("ij,ij->i", x[pr], mat[pq]))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[pq]), pa.array(ids[pr], pa.int64()), pa.array(score)], schema=kernels.HIT_SCHEMA)

        parts.append(rows.mapInArrow(run, retrieve.HIT_SCHEMA))
    return retrieve.rank_hits(retrieve._union(parts, retrieve.HIT_SCHEMA, spark), k)
