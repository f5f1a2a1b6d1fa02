"""Collection-level sources and sinks.

Tables are immutable Parquet version directories. A write never touches
what readers may be reading: an upsert or snapshot writes a *new* version
directory and then appends one row to a small version log; readers take
the latest logged version. A lost executor only repeats its task.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyrank.functions.vectors import all_tokens_dim, has_dim, sum_squares, token_size


#: Parquet options of tables with packed token vectors: a file's dictionary holds each token's vector once.
VECTOR_FILES = {"parquet.dictionary.page.size": str(64 << 20), "compression": "zstd"}


# ---------------------------------------------------------------------------
# S2 schema validation
# ---------------------------------------------------------------------------

def validate_vectors(points: DataFrame, dense_dim: int, late_dim: int,
                     dense_col: str = "dense", late_col: str = "late") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rows whose vectors violate the declared schema are
    rejected with a reason; missing vectors are allowed (partial points)."""
    d, m = F.col(dense_col), F.col(late_col)
    reason = (F.when(d.isNotNull() & ~has_dim(d, dense_dim), F.lit("dense_dim"))
              .when(d.isNotNull() & (sum_squares(d) <= 0), F.lit("dense_zero"))
              .when(m.isNotNull() & ~all_tokens_dim(m, late_dim), F.lit("late_dim"))
              .when(m.isNotNull() & F.exists(m, lambda t: sum_squares(t) <= 0), F.lit("late_zero")))
    tagged = points.withColumn("reason", reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def slice_multivector(v, tokens: int, dim: int):
    """Cut a flat vector into ``tokens`` vectors of ``dim`` (a multivector)."""
    return F.transform(F.sequence(F.lit(0), F.lit(tokens - 1)), lambda i: F.slice(v, i * dim + 1, dim))


# ---------------------------------------------------------------------------
# S3 upsert, S5 snapshots: versioned Parquet directories
# ---------------------------------------------------------------------------

def dedupe_latest(updates: DataFrame, key: str = "point_id", order_by: str = "seq") -> DataFrame:
    """Last write wins within a batch: highest ``order_by`` per key.

    ``max_by`` over a struct of the other columns, which may hold maps and
    vectors; equal ``order_by`` values are decided by a digest of the row, so
    the choice is deterministic. Combines map-side: a key updated a billion
    times is reduced before the shuffle.
    """
    rest = [c for c in updates.columns if c not in (key, order_by)]
    if not rest:
        return updates.groupBy(key).agg(F.max(order_by).alias(order_by)).select(*updates.columns)
    row = F.struct(*[F.col(c) for c in rest])
    best = F.max_by(F.struct(F.col(order_by), *[F.col(c) for c in rest]), F.struct(F.col(order_by), F.md5(F.to_json(row))))
    out = updates.groupBy(key).agg(best.alias("_best"))
    return out.select(key, *[F.col(f"_best.{c}").alias(c) for c in [order_by, *rest]]).select(*updates.columns)


def upsert_points(target: DataFrame, updates: DataFrame, key: str = "point_id",
                  order_by: str = "seq") -> DataFrame:
    """S3: replace-by-key, highest ``order_by`` wins, target rows included.

    So applying a batch twice, or an old batch after a newer one, changes
    nothing. Rows of other keys pass through untouched.
    """
    keys = updates.select(key).distinct()
    keep = target.join(keys, key, "left_anti")
    rivals = target.join(keys, key, "left_semi").unionByName(updates.select(*target.columns))
    return keep.unionByName(dedupe_latest(rivals, key, order_by))


LOG_SCHEMA = "version long, stream string, epoch long, data string"


class VersionedTable:
    """Immutable data directories plus an append-only version log.

    Data goes to a fresh directory first; the log row that names it publishes
    it. A directory without a log row (a crash between the two) is garbage
    that nobody reads, and never in the way of the next commit. One writer
    at a time.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base.rstrip("/")

    @property
    def log_path(self) -> str:
        return f"{self.base}/_log"

    def _log(self) -> DataFrame | None:
        """The log, or None before the first commit; any other failure rises."""
        try:
            return self.spark.read.schema(LOG_SCHEMA).parquet(self.log_path)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def current_version(self) -> int:
        log = self._log()
        return int(log.agg(F.max("version")).first()[0] or 0) if log is not None else 0

    def path(self, version: int) -> str:
        log = self._log()
        row = log.where(F.col("version") == version).select("data").first() if log is not None else None
        if row is None:
            raise ValueError(f"no version {version} in {self.base}")
        return f"{self.base}/{row[0]}"

    def read(self, version: int | None = None) -> DataFrame:
        v = self.current_version() if version is None else version
        return self.spark.read.parquet(self.path(v))

    def committed(self, stream: str, epoch: int) -> bool:
        """Was this micro-batch of this stream published? Epochs count per stream."""
        log = self._log()
        return log is not None and not log.where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()

    def publish(self, data: str, stream: str | None = None, epoch: int | None = None) -> int:
        """Name a directory below the base as the next version."""
        v = self.current_version() + 1
        self.spark.createDataFrame([(v, stream, epoch, data)], LOG_SCHEMA).write.mode("append").parquet(self.log_path)
        return v

    def commit(self, df: DataFrame, stream: str | None = None, epoch: int | None = None) -> int:
        data = f"data-{uuid.uuid4().hex}"
        df.write.mode("errorifexists").parquet(f"{self.base}/{data}")
        return self.publish(data, stream, epoch)

    def upsert(self, updates: DataFrame, key: str = "point_id", order_by: str = "seq",
               stream: str | None = None, epoch: int | None = None) -> int:
        cur = self.read()
        return self.commit(upsert_points(cur, updates.select(*cur.columns), key, order_by), stream, epoch)


def write_snapshot(df: DataFrame, base: str, version: str) -> str:
    """Write a named snapshot (a Parquet directory, never overwritten)."""
    path = f"{base.rstrip('/')}/snapshot={version}"
    df.write.options(**VECTOR_FILES).mode("errorifexists").parquet(path)
    return path


def restore_snapshot(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/snapshot={version}")


# ---------------------------------------------------------------------------
# S6 collection info
# ---------------------------------------------------------------------------

def collection_info(points: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """One row of counts per vector kind and dimension ranges (one pass)."""
    late_tokens = F.when(F.col("late").isNotNull(), F.size("late"))
    info = points.agg(
        F.count(F.lit(1)).cast("long").alias("n_points"),
        F.count("dense").cast("long").alias("n_dense"),
        F.count_if(F.size("late") > 0).cast("long").alias("n_late"),
        F.min(F.size("dense")).cast("long").alias("dense_dim_min"),
        F.max(F.size("dense")).cast("long").alias("dense_dim_max"),
        F.sum(late_tokens).cast("long").alias("late_vectors"),
        F.max(late_tokens).cast("long").alias("late_tokens_max"),
        F.min(token_size(points, "late")).cast("long").alias("late_dim"))
    if postings is not None:
        # scalar subqueries: two one-row aggregates, no join between them
        info = info.select(
            "*",
            postings.select(F.count(F.lit(1)).cast("long")).scalar().alias("n_postings"),
            postings.select(F.count_distinct("point_id").cast("long")).scalar().alias("n_sparse"))
    return info
