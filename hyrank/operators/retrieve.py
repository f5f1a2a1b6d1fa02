"""Retrieval (R1-R3, R8, R10-R12): score -> rank -> limit, for a query table.

The corpus side is never collected. The query side is: it is small by
nature, its size is checked before it is broadcast, and a query table
larger than ``max_query_bytes`` is split into blocks, each scored in its
own pass over the corpus (R12).

Ranking is ``row_number`` over ``(score desc, point_id asc)`` per query.
Each scan task already keeps only its local top-k; when the number of
contributing partitions is large, a salted first level (query, salt)
bounds what any single task has to sort, so a query matching a third of
the corpus is still spread over many tasks.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyrank.functions import kernels
from hyrank.functions.text import _token_vector
from hyrank.session import work_dir

MAX_QUERY_BYTES = 64 << 20          # per broadcast query block
MAX_BROADCAST_ROWS = 2_000_000      # bound for broadcasting candidate/term sets

HIT_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType(), True),
    T.StructField("point_id", T.LongType(), True),
    T.StructField("score", T.DoubleType(), True),
])


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _ensure_group_limit(spark: SparkSession, k: int | None) -> None:
    """Keep WindowGroupLimit (partial top-k before the shuffle) for large k."""
    if k is None:
        return
    cur = int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if k > cur:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", str(k))


MAX_PUSHED_TERMS = 256   # query-term IN lists up to this size are pushed to the scan (deeper lists
                        # overflow the Parquet filter tree; larger batches scan with the broadcast join)


def _ensure_in_pushdown(spark: SparkSession, n: int) -> None:
    """Let Parquet evaluate IN lists of n values (default: only up to 10)."""
    key = "spark.sql.parquet.pushdown.inFilterThreshold"
    if n > int(spark.conf.get(key, "10")):
        spark.conf.set(key, str(n))


def auto_salt(n_partitions: int) -> int:
    """sqrt-fan-in for the two-level top-k; 1 (off) for small inputs."""
    return int(math.isqrt(n_partitions)) if n_partitions >= 64 else 1


_NARROW = re.compile(r"^[ :+-]*(Project|Filter|Relation|RelationV2|LocalRelation|LogicalRDD|Range|Union|SubqueryAlias)\b")


def scan_partitions(df: DataFrame) -> int:
    """Partition count of a plain scan; for plans with a shuffle, which must not be run to
    be asked, the shuffle's partition number."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if all(_NARROW.match(line) for line in plan.splitlines() if line.strip()):
        return df.rdd.getNumPartitions()
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def rank_hits(cand: DataFrame, k: int | None, salt_buckets: int = 1,
              group: tuple[str, ...] = ("query_id",), bounded: bool = False) -> DataFrame:
    """(group..., point_id, score) -> + rank (bigint), best first, rank <= k.

    Without ``k`` lists may be of any length (``rank_all``), unless the caller knows them to be
    ``bounded`` by the limits of prefetches: such a list is ordered in one task.
    """
    if k is None and not bounded:
        return rank_all(cand, group)
    _ensure_group_limit(_spark(cand), k)
    order = [F.col("score").desc(), F.col("point_id").asc()]
    if k is not None and salt_buckets > 1:
        w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
        cand = (cand.withColumn("_salt", F.pmod(F.xxhash64("point_id"), F.lit(salt_buckets)))
                .withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt"))
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = cand.withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def rank_all(cand: DataFrame, group: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Ranks of whole result lists, however long: no task holds a group's list.

    Hits are range-partitioned by (group, score, point_id) and sorted; each
    partition counts its own hits of a group (a streaming pass), and the
    counts of the partitions before it are added. The numbered hits are written once
    (checkpoint), so the search below runs once for its range bounds and its ranks.
    """
    spark = _spark(cand)
    work_dir(spark)
    cand = cand.checkpoint()
    keys = [*[F.col(c) for c in group], F.col("score").desc(), F.col("point_id").asc()]
    parts = cand.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*cand.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    local = parts.mapInArrow(kernels.number_kernel(list(group)), schema).checkpoint()
    sizes = local.groupBy(*group, "_part").agg(F.max("_local").alias("_n"))           # groups x partitions at most
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    keys = [*group, "_part"]
    sizes = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_before")
    on = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    return local.join(sizes, on).select(*cand.columns, (F.col("_before") + F.col("_local")).alias("rank"))


# ---------------------------------------------------------------------------
# Query blocks (bounded driver-side query matrices)
# ---------------------------------------------------------------------------

def _n_blocks(queries: DataFrame, elems: Column, max_bytes: int) -> int:
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.sum(elems).alias("e")).first()
    n, e = int(row["n"] or 0), int(row["e"] or 0)
    return max(1, math.ceil((e * 8 + n * 16) / max_bytes))


def _blocks(queries: DataFrame, n_blocks: int):
    if n_blocks == 1:
        yield queries
        return
    blk = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    for b in range(n_blocks):
        yield queries.where(blk == b)


def dense_query_blocks(queries: DataFrame, vec_col: str = "dense", max_bytes: int = MAX_QUERY_BYTES):
    q = queries.select("query_id", vec_col).where(F.col(vec_col).isNotNull())
    for blk in _blocks(q, _n_blocks(q, F.size(vec_col), max_bytes)):
        tbl = blk.toArrow()
        if tbl.num_rows == 0:
            continue
        qids = tbl.column("query_id").to_numpy()
        col = tbl.column(vec_col).combine_chunks()
        dims = col.value_lengths().to_numpy(zero_copy_only=False)
        if len(set(dims.tolist())) != 1:
            raise ValueError(f"query vectors of different sizes in {vec_col}: {sorted(set(dims.tolist()))}")
        mat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(qids), int(dims[0]))
        order = np.argsort(qids)
        yield qids[order].astype(np.int64), mat[order]


def late_query_blocks(queries: DataFrame, vec_col: str = "late", max_bytes: int = MAX_QUERY_BYTES):
    q = queries.select("query_id", vec_col).where(F.size(vec_col) > 0)
    elems = F.aggregate(F.col(vec_col), F.lit(0), lambda a, t: a + F.size(t))
    for blk in _blocks(q, _n_blocks(q, elems, max_bytes)):
        tbl = blk.sort("query_id").toArrow()
        if tbl.num_rows == 0:
            continue
        qids = tbl.column("query_id").to_numpy().astype(np.int64)
        col = tbl.column(vec_col).combine_chunks()
        lens = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        inner = col.flatten()
        dims = inner.value_lengths().to_numpy(zero_copy_only=False)
        if len(set(dims.tolist())) != 1:
            raise ValueError(f"query token vectors of different sizes in {vec_col}")
        toks = inner.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, int(dims[0]))
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        yield qids, toks, starts


def bounded_broadcast(df: DataFrame, bound: int | None = None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only behind a size check; otherwise leave the join to
    a shuffle (and AQE's skew handling).

    ``bound`` is a proven upper bound on the rows (e.g. queries x k); when
    it is unknown the rows are counted -- only ever done for query-side
    tables, never for the corpus.
    """
    n = bound if bound is not None else df.count()
    return F.broadcast(df) if n <= max_rows else df


def _union(parts: list[DataFrame], schema: T.StructType, spark: SparkSession) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# R1 / R1b dense, R3 late
# ---------------------------------------------------------------------------

def dense_topk(points: DataFrame, queries: DataFrame, k: int | None = 10, threshold: float | None = None,
               vec_col: str = "dense", max_query_bytes: int = MAX_QUERY_BYTES,
               salt_buckets: int | None = None, ranked: bool = True) -> DataFrame:
    """Cosine top-k per query (vectors are unit length).

    The threshold is applied inside the scan, so the score is computed once
    and only passing points leave the task.
    """
    spark = _spark(points)
    corpus = points.select("point_id", vec_col).where(F.col(vec_col).isNotNull())
    parts = []
    for qids, mat in dense_query_blocks(queries, vec_col, max_query_bytes):
        bc = spark.sparkContext.broadcast((qids, mat))
        parts.append(corpus.mapInArrow(kernels.dense_topk_kernel(bc, k, threshold, "point_id", vec_col), HIT_SCHEMA))
    hits = _union(parts, HIT_SCHEMA, spark)
    if k is None and not ranked:
        return hits
    salt = salt_buckets if salt_buckets is not None else auto_salt(scan_partitions(corpus))
    return rank_hits(hits, k, salt)


def side_blocks(df: DataFrame, vec_col: str, block_bytes: int) -> int:
    """Blocks of one side: of about ``block_bytes``, but not more than the cores need or MAX_QUERY_BYTES asks for."""
    spark = _spark(df)
    enough = math.isqrt(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)) + 1
    return min(_n_blocks(df, F.size(vec_col), block_bytes), max(enough, _n_blocks(df, F.size(vec_col), MAX_QUERY_BYTES)))


def dense_topk_blocks(points: DataFrame, queries: DataFrame, k: int = 10, vec_col: str = "dense",
                      block_bytes: int = MAX_QUERY_BYTES // 8) -> DataFrame:
    """``dense_topk`` for a query table as large as a corpus; neither side is collected.

    Both sides are dealt into blocks by a hash of the id; the rows of a block go to each of its pairs
    with the other side's blocks, and a pair is scored in one task. The plan does not grow with the blocks. Blocks are of about
    ``block_bytes``, but no more of them than give every core several pairs, as long as they stay below
    MAX_QUERY_BYTES: each row is sent as many times as the other side has blocks.
    """
    def dealt(df, id_col):
        df = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col(vec_col).isNotNull())
        n = side_blocks(df, "v", block_bytes)
        return df.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), n

    (asks, n_asks), (rows, n_rows) = dealt(queries, "query_id"), dealt(points, "point_id")
    asks = asks.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    both = asks.select(F.col("own").alias("qb"), F.col("other").alias("pb"), F.lit(0).alias("side"), "id", "v").unionByName(
        rows.select(F.col("other").alias("qb"), F.col("own").alias("pb"), F.lit(1).alias("side"), "id", "v"))
    both = both.repartitionById(n_asks * n_rows, F.col("qb") * n_rows + F.col("pb")).sortWithinPartitions("qb", "pb", "side")
    return rank_hits(both.mapInArrow(kernels.dense_block_kernel(k), HIT_SCHEMA), k, auto_salt(n_rows))


def late_topk(points: DataFrame, queries: DataFrame, k: int | None = 10, vec_col: str = "late",
              max_query_bytes: int = MAX_QUERY_BYTES, salt_buckets: int | None = None) -> DataFrame:
    """MaxSim top-k -- sum over query tokens of the best document token."""
    spark = _spark(points)
    corpus = points.select("point_id", vec_col).where(F.size(vec_col) > 0)
    parts = []
    for qids, qtok, qstarts in late_query_blocks(queries, vec_col, max_query_bytes):
        bc = spark.sparkContext.broadcast((qids, qtok, qstarts))
        parts.append(corpus.mapInArrow(kernels.late_topk_kernel(bc, k, "point_id", vec_col), HIT_SCHEMA))
    salt = salt_buckets if salt_buckets is not None else auto_salt(scan_partitions(corpus))
    return rank_hits(_union(parts, HIT_SCHEMA, spark), k, salt)


def bucket_of(n_buckets: int, id_col: str = "point_id") -> Column:
    """The bucket directory of a point (see plans.collection)."""
    return F.pmod(F.xxhash64(id_col), F.lit(n_buckets)).cast("int")


def n_buckets(points: DataFrame) -> int | None:
    """How many bucket directories the points table has, if it is laid out so."""
    return points.schema["bucket"].metadata.get("buckets") if "bucket" in points.columns else None


def at_points(side: DataFrame, points: DataFrame, cols: list[str], bound: int | None, how: str = "inner") -> DataFrame:
    """Columns of the points that ``side`` (point_id, ...) names, joined to it.

    Points lie in directories by a hash of the id; the side's buckets prune them while the
    query runs (dynamic partition pruning on the broadcast side), so only buckets with a wanted point are read. A side
    without a small bound is left to a shuffle join.
    """
    on = ["point_id"]
    n = n_buckets(points)
    if n:
        # always true; a side without any comparison is not thought worth pruning by
        side, on = side.withColumn("bucket", bucket_of(n)).where(F.col("bucket") >= 0), ["bucket", "point_id"]
    if bound is not None and bound <= MAX_BROADCAST_ROWS:
        side = F.broadcast(side)
    return points.select(*on, *cols).join(side, on, how).drop("bucket")


def candidate_rows(candidates: DataFrame, points: DataFrame, cols: list[str], bound: int | None) -> DataFrame:
    """(point_id, cols..., qids): each candidate point once, with the queries that chose it."""
    wanted = candidates.where(F.col("point_id").isNotNull()).groupBy("point_id").agg(F.collect_list("query_id").alias("qids"))
    return at_points(wanted, points, cols, bound)


def late_rescore(candidates: DataFrame, points: DataFrame, queries: DataFrame, vec_col: str = "late",
                 max_query_bytes: int = MAX_QUERY_BYTES, candidate_bound: int | None = None,
                 k: int | None = None) -> DataFrame:
    """MaxSim for given (query_id, point_id) pairs only.

    Candidates are grouped per point (a point lists at most every query),
    so each point's vectors are read and shipped once, and buckets without a
    candidate are not read (``at_points``). With ``k`` only each task's
    per-query top-k is returned (enough for a top-k rank).
    """
    spark = _spark(points)
    rows = candidate_rows(candidates, points, [vec_col], candidate_bound).where(F.size(vec_col) > 0)
    parts = []
    for qids, qtok, qstarts in late_query_blocks(queries, vec_col, max_query_bytes):
        bc = spark.sparkContext.broadcast((qids, qtok, qstarts))
        parts.append(rows.mapInArrow(kernels.late_pair_kernel(bc, vec_col, k=k), HIT_SCHEMA))
    return _union(parts, HIT_SCHEMA, spark)


# ---------------------------------------------------------------------------
# R2 sparse
# ---------------------------------------------------------------------------

def weighted_query_terms(query_terms: DataFrame, idf: DataFrame, n_terms: int | None = None) -> DataFrame:
    """(query_id, term, qweight) + idf; the vocabulary table is only probed."""
    return idf.select("term", "idf").join(bounded_broadcast(query_terms, n_terms), "term")


def sparse_scores(postings: DataFrame, idf: DataFrame, query_terms: DataFrame,
                  candidates: DataFrame | None = None, candidate_bound: int | None = None,
                  allowed: DataFrame | None = None) -> DataFrame:
    """Sum over shared terms of qweight * weight * idf, per (query, point).

    Postings stream past a broadcast of the weighted query terms, so a hot
    term never meets a hot shuffle partition; the (query, point) sum is
    combined map-side. Only points sharing a term get a score.
    """
    n_terms = query_terms.count()          # query side only: bounded, cheap
    qt = weighted_query_terms(query_terms, idf, n_terms)
    post = postings.select("point_id", "term", "weight")
    if n_terms <= MAX_PUSHED_TERMS:
        # a literal IN list reaches the Parquet reader: term-sorted postings
        # files and row groups outside the query terms are skipped
        terms = [r[0] for r in query_terms.select("term").distinct().collect()]
        _ensure_in_pushdown(postings.sparkSession, len(terms))
        post = post.where(F.col("term").isin(terms))
    m = post.join(bounded_broadcast(qt, n_terms), "term")
    if candidates is not None:
        c = candidates.select("query_id", "point_id")
        if candidate_bound is not None and candidate_bound <= MAX_BROADCAST_ROWS:
            c = F.broadcast(c)
        m = m.join(c, ["query_id", "point_id"], "left_semi")
    s = m.groupBy("query_id", "point_id").agg(
        F.sum(F.col("qweight") * F.col("weight") * F.col("idf")).alias("score"))
    if allowed is not None:
        # payload filter: applied to the (query, point) scores, before ranking --
        # the same result as filtering postings, without shuffling the postings
        s = s.join(allowed.select("point_id"), "point_id", "left_semi")
    return s.select("query_id", "point_id", (F.round("score", kernels.SCORE_DECIMALS) + 0.0).alias("score"))


def sparse_topk(postings: DataFrame, idf: DataFrame, query_terms: DataFrame, k: int | None = 10,
                candidates: DataFrame | None = None, candidate_bound: int | None = None,
                salt_buckets: int | None = None, allowed: DataFrame | None = None, ranked: bool = True) -> DataFrame:
    """R2: IDF-weighted sparse dot product top-k (``allowed``: payload-filtered points)."""
    s = sparse_scores(postings, idf, query_terms, candidates, candidate_bound, allowed)
    if k is None and not ranked:
        return s
    salt = salt_buckets if salt_buckets is not None else auto_salt(
        int(_spark(postings).conf.get("spark.sql.shuffle.partitions")))
    return rank_hits(s, k, salt)


# ---------------------------------------------------------------------------
# R8 prefetch, R10 paging
# ---------------------------------------------------------------------------

def prefetch(hits: DataFrame, n: int) -> DataFrame:
    """Branch-local top-n of an already ranked hit list."""
    return hits.where(F.col("rank") <= n)


def cursor_of(page: DataFrame) -> DataFrame:
    """(query_id, after_score, after_id) of the last hit each query has in a page."""
    last = page.groupBy("query_id").agg(F.max_by(F.struct("score", "point_id"), "rank").alias("l"))
    return last.select("query_id", F.col("l.score").alias("after_score"), F.col("l.point_id").alias("after_id"))


def dense_page(points: DataFrame, queries: DataFrame, size: int, cursor: DataFrame | None = None, vec_col: str = "dense",
               max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """The next ``size`` hits of each query behind its cursor (score, point_id), ranked from 1.

    The bound goes to the scan kernel, whose tasks keep ``size`` hits a query whatever the page: page n
    costs what page 1 does, where a rank range would keep and rank n x size. A query without a cursor
    row has no further hits. Cursors are as many as queries and travel with them.
    """
    spark = _spark(points)
    corpus = points.select("point_id", vec_col).where(F.col(vec_col).isNotNull())
    if cursor is not None:
        queries = queries.select("query_id", vec_col).join(bounded_broadcast(cursor), "query_id")
    parts = []
    for qids, mat in dense_query_blocks(queries, vec_col, max_query_bytes):
        after = None
        if cursor is not None:
            # as many rows as queries, which are on the driver already
            rows = cursor.where(F.col("query_id").isin([int(q) for q in qids])).collect() if len(qids) <= MAX_PUSHED_TERMS else cursor.collect()
            at = {r["query_id"]: (r["after_score"], r["after_id"]) for r in rows}
            after = [at[int(q)] for q in qids]
        bc = spark.sparkContext.broadcast((qids, mat))
        parts.append(corpus.mapInArrow(kernels.dense_topk_kernel(bc, size, None, "point_id", vec_col, after), HIT_SCHEMA))
    return rank_hits(_union(parts, HIT_SCHEMA, spark), size, auto_salt(scan_partitions(corpus)))


def page_hits(hits: DataFrame, page_no: int | None = None, size: int = 10) -> DataFrame:
    """Rank once, then a page is a rank range; ``page_no=None`` labels all.

    The upper end of the range becomes a limit of the ranking itself.
    """
    if page_no is not None:
        hits = hits.where((F.col("rank") > page_no * size) & (F.col("rank") <= (page_no + 1) * size))
    return hits.withColumn("page", F.floor((F.col("rank") - 1) / size).cast("long"))


# ---------------------------------------------------------------------------
# R11 approximate dense search (random-hyperplane LSH, exact rescoring)
# ---------------------------------------------------------------------------

def _hyperplanes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    """Fixed random normals from the embedder's token hash, so that SQL can reproduce them."""
    return np.stack([[_token_vector(f"plane{seed}:{t}:{b}", dim) for b in range(bits)] for t in range(tables)])


def lsh_buckets(df: DataFrame, id_col: str, vec_col: str, planes: np.ndarray) -> DataFrame:
    """(id, v, sig): each vector with its bucket in every hash table.

    The projections are one small matrix product per Arrow batch; the
    hyperplanes are a fixed-size broadcast (tables x bits x dim).
    """
    tables, bits, dim = planes.shape
    bc = df.sparkSession.sparkContext.broadcast(planes)

    def run(batches):
        import pyarrow as pa
        pl = bc.value.reshape(tables * bits, dim)
        weights = (1 << np.arange(bits)).astype(np.int64)
        for b in batches:
            rows, mat = kernels._flat_vectors(b.column("v"), dim)
            if len(rows) == 0:
                continue
            codes = ((mat @ pl.T > 0).reshape(len(rows), tables, bits) * weights).sum(axis=2)       # (n, tables)
            off = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables)
            own = [b.column(c).take(pa.array(rows)) for c in ("id", "v")]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(off, pa.array(codes.ravel(), pa.int64()))], names=["id", "v", "sig"])

    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("sig", T.ArrayType(T.LongType()))]))


LSH_PART = 1 << 15      # queries of a bucket that one task holds


def dense_lsh_topk(points: DataFrame, queries: DataFrame, k: int = 10, tables: int = 16, bits: int = 6,
                   seed: int = 7, vec_col: str = "dense", dim: int | None = None) -> DataFrame:
    """Bucket candidates on (table, bucket), then exact cosine and rank.

    Every candidate is scored exactly; recall versus R1 is reported by
    ``lsh_recall``. No bucket is capped: vectors are sent to their bucket of each table, the pairs of a bucket
    are scored where they meet and its k best a query leave the task, so candidates are never rows of a
    shuffle. A bucket of many vectors is dealt into parts of LSH_PART queries and as many points times 4.
    """
    if dim is None:
        dim = int(queries.select(F.max(F.size(vec_col))).first()[0])
    planes = _hyperplanes(dim, tables, bits, seed)

    def bucketed(df, id_col, side):
        rows = lsh_buckets(df.where(F.col(id_col).isNotNull()), id_col, vec_col, planes)
        return rows.select("id", "v", "sig", F.posexplode("sig").alias("table", "bucket"), F.lit(side).alias("side"))

    asks, rows = bucketed(queries, "query_id", 0), bucketed(points, "point_id", 1)
    # at most tables x buckets rows; parts > 1 only where a bucket is crowded
    sizes = asks.select("table", "bucket", "side").unionByName(rows.select("table", "bucket", "side")).groupBy("table", "bucket").agg(
        F.ceil(F.count_if(F.col("side") == 0) / LSH_PART).alias("q_parts"), F.ceil(F.count_if(F.col("side") == 1) / (4 * LSH_PART)).alias("p_parts"))
    sizes = bounded_broadcast(sizes.where("q_parts > 0 and p_parts > 0"), tables << bits)

    def placed(df, own, other):
        df = df.join(sizes, ["table", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col(own)))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        part = {"q_parts": ("own", "other"), "p_parts": ("other", "own")}[own]
        return df.select((F.col("table") * F.lit(kernels.BLOCK_SHIFT) + F.col(part[0])).alias("qb"),
                         (F.col("bucket") * F.lit(kernels.BLOCK_SHIFT) + F.col(part[1])).alias("pb"), "side", "id", "v", "sig")

    both = placed(asks, "q_parts", "p_parts").unionByName(placed(rows, "p_parts", "q_parts"))
    both = both.repartition("qb", "pb").sortWithinPartitions("qb", "pb", "side")
    return rank_hits(both.mapInArrow(kernels.dense_block_kernel(k, "sig"), HIT_SCHEMA), k)


def lsh_recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query: |approx top-k ∩ exact top-k| / |exact top-k|."""
    work_dir(_spark(exact))
    exact = exact.checkpoint()              # read twice
    inter = exact.join(approx.select("query_id", "point_id"), ["query_id", "point_id"], "left_semi")
    a = inter.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    e = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    return e.join(a, "query_id", "left").select(
        "query_id", F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.col("wanted").cast("long"),
        (F.coalesce("found", F.lit(0)) / F.col("wanted")).alias("recall"))
