"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table's hash: the unit vector goes through three rounds of random signs and
a fast Hadamard transform; its bucket is the nearest signed axis (the largest
absolute coordinate and its sign). Large indexes add a second, smaller
cross-polytope (``axes2``) so that buckets keep about ``bucket_rows`` vectors.

Every vector is listed in one bucket of each of ``TABLES`` tables; a query
probes the best buckets of each, ranked by its own coordinates. How many is
fitted on a bounded sample (``FIT_QUERIES`` queries, ``FIT_ROWS`` rows): the smallest number
that finds ``TARGET_RECALL`` of the sample's true k nearest. Neighbours within a
sample are farther than in the whole, so the fit errs to more probes. Every row is indexed.
Rows of a bucket and the queries that probe it meet in one task, queries
first; index rows stream past in batches and only a local top k of each query leaves it. A bucket
above ``SALT_ROWS`` rows is dealt out over several tasks and its queries copied to each.
Candidates are ranked by the exact Euclidean distance of the original vectors in
double precision, ties to the smaller id.

A query that finds fewer than k (and fewer than there are) is searched
again over all buckets of one table, which is an exact scan.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another length than the most frequent one. A
repeated id counts as one candidate (its nearest copy), and never as its own neighbour; null ids take
no part. ``recall`` compares a result with brute force.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyrank.llm.common import cut, table

TABLES = 6
TARGET_RECALL = 0.96
FIT_ROWS = 20_000
FIT_QUERIES = 200
BUCKET_ROWS = 4096
SALT_ROWS = 20_000
QUERY_BLOCK = 512
TILE = 2048
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    src = src.where(fine)
    width = src.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).select("d")
    return src.where(F.size("v") == width.scalar())


def signs(dim: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs (table, polytope, round, coordinate) with ``dim`` padded to a power of two."""
    width = 1 << max(1, (dim - 1).bit_length())
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 2, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    for s in sign:
        x = hadamard(x * s)
    return x


def _unit(v: np.ndarray, width: int) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / big
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.pad(v, ((0, 0), (0, width - v.shape[1])))


def axis_scores(v: np.ndarray, sign: np.ndarray, axes2: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Coordinates along all signed axes of one table's polytopes."""
    u = _unit(v, sign.shape[-1])
    a = rotated(u, sign[0])
    first = np.concatenate([a, -a], axis=1)
    if axes2 < 2:
        return first, None
    b = rotated(u, sign[1])[:, :axes2 // 2]
    return first, np.concatenate([b, -b], axis=1)


def buckets(v: np.ndarray, sign: np.ndarray, axes2: int) -> np.ndarray:
    a, b = axis_scores(v, sign, axes2)
    out = a.argmax(axis=1)
    return out if b is None else out * axes2 + b.argmax(axis=1)


#: Scores of (rows x buckets) that exist at once: 32 MB.
PROBE_CELLS = 1 << 22


def _steps(rows: int, sign: np.ndarray, axes2: int, dim: int) -> list[slice]:
    """Runs of rows whose scores against all buckets stay within PROBE_CELLS."""
    a, b = axis_scores(np.ones((1, dim)), sign, axes2)
    step = max(1, PROBE_CELLS // (a.shape[1] * (1 if b is None else b.shape[1])))
    return [slice(lo, lo + step) for lo in range(0, rows, step)]


def probes(v: np.ndarray, sign: np.ndarray, axes2: int, count: int) -> np.ndarray:
    """The ``count`` best buckets of each row: those that lose least score to the nearest axes."""
    out = []
    for rows in _steps(len(v), sign, axes2, v.shape[1]):
        a, b = axis_scores(v[rows], sign, axes2)
        if b is not None:
            a = (a[:, :, None] + b[:, None, :]).reshape(len(a), -1)
        out.append(np.argsort(-a, axis=1, kind="stable")[:, :count].copy())       # a view would hold all of it
    return np.concatenate(out) if out else np.zeros((0, count), np.int64)


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


LISTED = "tab int, bucket long, salt int, side int, id long, v array<double>"


def search(queries: DataFrame, index: DataFrame, k: int = 10, tables: int = TABLES, probe_count: int | None = None,
           bucket_rows: int = BUCKET_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest found for each query id. Inputs as from ``usable``."""
    index = cut(index)
    ids, rows, dim = index.agg(F.countDistinct("id"), F.count(F.lit(1)), F.max(F.size("v"))).first()
    if ids < rows:                                       # equal copies of a row are one
        index = cut(index.select("id", "v").distinct())
        rows = index.count()
    queries = cut(queries.groupBy("id").agg(F.min("v").alias("v")))
    if not rows:
        return queries.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"),
                                       F.lit(0.0).alias("score"))
    sign = signs(dim, tables, seed)
    width = sign.shape[-1]
    axes2 = 0
    while rows / (2 * width * max(1, axes2)) > bucket_rows and axes2 < 2 * width:
        axes2 = max(2, axes2 * 2)
    total = 2 * width * max(1, axes2)

    probe_count = probe_count or fit_probes(queries, index, k, sign, axes2, total)
    found = cut(_probe(queries, index, k, sign, axes2, tables, min(probe_count, total)))
    others = ids - 1
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, others)).select(F.col("query_id").alias("id"))
    short = cut(queries.join(enough, "id", "left_anti"))
    if not short.isEmpty():
        again = _probe(short, index, k, sign[:1], axes2, 1, total)
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found


def fit_probes(queries: DataFrame, index: DataFrame, k: int, sign: np.ndarray, axes2: int, total: int) -> int:
    """The smallest probe count that reaches TARGET_RECALL on the sample."""
    def sample(df, n):
        got = df.orderBy(F.xxhash64("id"), "id").limit(n).toPandas()
        return got["id"].to_numpy(), np.stack(got["v"].to_numpy()) if len(got) else np.zeros((0, 1))

    qid, q = sample(queries, FIT_QUERIES)
    rid, r = sample(index, FIT_ROWS)
    if not len(qid):
        return 1
    dist = (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2.0 * (q @ r.T)
    dist[qid[:, None] == rid[None, :]] = np.inf
    near = np.argsort(dist, axis=1)[:, :k]
    real = np.isfinite(np.take_along_axis(dist, near, axis=1))
    best = np.full(near.shape, total)
    for s in sign:
        own = buckets(r, s, axes2)[near]
        for rows in _steps(len(q), s, axes2, q.shape[1]):
            place = np.empty((len(q[rows]), total), np.int64)
            np.put_along_axis(place, probes(q[rows], s, axes2, total), np.arange(total)[None, :], axis=1)
            best[rows] = np.minimum(best[rows], np.take_along_axis(place, own[rows], axis=1))
    places = np.sort(best[real])
    return int(places[min(len(places) - 1, int(np.ceil(TARGET_RECALL * len(places))))]) + 1 if len(places) else 1


def _probe(queries, index, k, sign, axes2, tables, probe_count):
    def list_index(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                for t in range(tables):
                    yield _listed(t, buckets(v, sign[t], axes2), 1, b.column("id"), b.column("v"))

    def list_queries(batches):
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                for t in range(tables):
                    own = probes(v, sign[t], axes2, probe_count)
                    at = pa.array(np.repeat(np.arange(len(v)), own.shape[1]))
                    yield _listed(t, own.ravel(), 0, b.column("id").take(at), b.column("v").take(at))

    rows = index.select("id", "v").mapInArrow(list_index, LISTED)
    size = rows.groupBy("tab", "bucket").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    hot = cut(size.where("salts > 1"))
    rows = rows.drop("salt").join(hot, ["tab", "bucket"], "left").withColumn(
        "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id", "v"), F.col("salts"))).otherwise(0).cast("int")).drop("salts")
    asks = queries.select("id", "v").mapInArrow(list_queries, LISTED).drop("salt").join(hot, ["tab", "bucket"], "left")
    asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    # queries of a bucket come in blocks; every block meets the whole bucket
    both = asks.unionByName(rows).repartition("tab", "bucket", "salt").sortWithinPartitions("tab", "bucket", "salt", "side", "id")
    local = both.mapInArrow(_nearest(k), "query_id long, vec_id long, score double")
    best = local.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _listed(tab, bucket, side, ids, v):
    n = len(bucket)
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, tab, np.int32)), pa.array(bucket.astype(np.int64)), pa.array(np.zeros(n, np.int32)),
         pa.array(np.full(n, side, np.int32)), ids, v], names=["tab", "bucket", "salt", "side", "id", "v"])


def _nearest(k: int):
    """Exact local top k of the queries of each bucket over its rows."""
    def run(batches):
        key, asked, vectors, best = None, [], [], {}

        def close():
            q = [(i, s, x) for i, top in best.items() for s, x in top]
            if q:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in q], pa.int64()), pa.array([x[2] for x in q], pa.int64()),
                                                  pa.array([x[1] for x in q], pa.float64())], names=["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tab", "bucket", "salt", "side", "id")]
            v = _matrix(b.column("v"))
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            for lo, hi in zip(np.append(0, change), np.append(change, b.num_rows)):
                now = tuple(int(c[lo]) for c in cols[:3])
                if now != key:
                    yield from close()
                    key, asked, vectors, best = now, [], [], {}
                if cols[3][lo] == 0:
                    asked.append(cols[4][lo:hi].copy())
                    vectors.append(v[lo:hi].copy())
                elif asked:
                    if len(asked) > 1:
                        asked, vectors = [np.concatenate(asked)], [np.concatenate(vectors)]
                    for q in range(0, len(asked[0]), QUERY_BLOCK):
                        for r in range(lo, hi, TILE):
                            _scan(asked[0][q:q + QUERY_BLOCK], vectors[0][q:q + QUERY_BLOCK],
                                  cols[4][r:min(hi, r + TILE)], v[r:min(hi, r + TILE)], k, best)
        yield from close()

    return run


def _scan(qids, q, ids, v, k, best) -> None:
    # a screen by the expanded square, then the exact difference for what may enter the top k
    scale = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :]
    rough = scale - 2.0 * (q @ v.T)
    slack = 1e-9 * scale + 1e-300
    # the bound is the k-th over ids, each by its best row (rows are sorted by id), the query's own id left out
    upper = np.where(qids[:, None] == ids[None, :], np.inf, rough + slack)
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    if len(first) < len(ids):
        upper = np.minimum.reduceat(upper, first, axis=1)
    n = min(len(first), k)
    bound = np.partition(upper, n - 1, axis=1)[:, n - 1]
    for i, query in enumerate(qids.tolist()):
        near = np.flatnonzero((rough[i] - slack[i] <= bound[i]) & (ids != query))
        if not len(near):
            continue
        dist = np.sqrt(((q[i] - v[near]) ** 2).sum(axis=1))
        top = best.get(query, [])
        known = dict((x, s) for s, x in top)
        for s, x in zip(dist.tolist(), ids[near].tolist()):
            known[x] = min(s, known.get(x, s))
        best[query] = sorted((s, x) for x, s in known.items())[:k]


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of exact (query_id, vec_id) pairs that were found."""
    both = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return both / max(1, exact.count())


def op6(spark, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors.where("id % 100 = 0"), vectors)
