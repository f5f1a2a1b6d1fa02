"""The searchable collection: points, postings, IDF and manifest, written once as Parquet.

Ingest reads every text once and writes, under a fresh directory in the shared work folder:

* ``points``   point_id, payload, dl, terms, tf, weights, dense, late (token vectors as bytes of float32: a file's
  dictionary holds a token's vector once); in directories ``bucket=`` by a hash of the
  id, sorted by id inside, so that reading some points reads their buckets only
* ``postings`` point_id, term, tf, dl, weight and the filterable payload (sorted by term per file)
* ``idf``      term, n, idf
* ``blocks``   block-max postings (operators.blockmax)
* ``manifest`` one row: sizes, dimensions, payload and layout; written last, so a directory without it
  is no collection

Search jobs read these tables, so the embedding work is never repeated per
strategy, and the written tables cut the lineage (a lost executor replays
from Parquet, not from the raw text).
"""

from __future__ import annotations

import json
import math
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyrank.functions.vectors import token_size
from hyrank.operators import blockmax, ivf, represent, shape
from hyrank.operators.retrieve import at_points, bounded_broadcast, bucket_of, scan_partitions
from hyrank.session import scratch_path, ship_package
from hyrank.sources import tables
from hyrank.sources.collection_ops import VECTOR_FILES

TABLES = ("points", "postings", "idf", "blocks")
POINTS_PER_BUCKET = 4096
MIN_BUCKETS, MAX_BUCKETS = 8, 1 << 14


@dataclass
class Collection:
    points: DataFrame
    postings: DataFrame
    idf: DataFrame
    path: str
    blocks: DataFrame | None = None
    manifest: dict = field(default_factory=dict)
    index: DataFrame | None = None          # inverted-file index of the dense vectors (operators.ivf), if one was built
    quantizer: ivf.Quantizer | None = None


@dataclass
class QuerySet:
    queries: DataFrame      # query_id, text, dense, late
    terms: DataFrame        # query_id, term, qweight
    n: int
    dims: dict = field(default_factory=dict)


def document_payload(docs: DataFrame) -> DataFrame:
    """Documents with the payload fields the searches return."""
    return docs.select(
        F.col("doc_id"), F.col("text"),
        F.substring_index(F.coalesce(F.col("text"), F.lit("")), "\n", 1).alias("headline"),
        F.col("lang"), F.col("source"), F.col("n_chars"))


PAYLOAD = ["headline", "lang", "source", "n_chars"]
#: Payload that postings carry too, so that a filter on it is pushed into their scan.
FILTERABLE = ["lang", "source"]


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that has fewer partitions than the cluster has cores.

    Large inputs (many files / row groups) are already split finer than the
    parallelism and pass through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if scan_partitions(df) < want else df


def bucket_count(about: int) -> int:
    return int(min(MAX_BUCKETS, max(MIN_BUCKETS, math.ceil(about / POINTS_PER_BUCKET))))


def deal(df: DataFrame, buckets: int, id_col: str = "point_id") -> DataFrame:
    """Rows to their bucket's own partition."""
    return df.repartitionById(buckets, bucket_of(buckets, id_col))


@contextmanager
def file_by_file(spark: SparkSession):
    """Scans that run inside read each file in a partition of its own: a bucket at a time, so rows stay in their bucket
    without a shuffle and a sort holds one bucket."""
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, spark.conf.get("spark.sql.files.maxPartitionBytes"))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_collection(spark: SparkSession, docs: DataFrame, path: str | None = None,
                     payload: list[str] = PAYLOAD, filterable: list[str] | None = None, **how) -> Collection:
    """``how``: dense_dim, late_dim, stopwords, embedder of ``represent.build_points``.

    Texts are dealt to the buckets before they are embedded: vectors, many times their size, are not shuffled.
    """
    path = path or scratch_path(spark, "collection")
    about = docs.count()
    points, _ = represent.build_points(deal(docs, bucket_count(about), "doc_id"), "doc_id", "text", payload=payload, **how)
    filterable = [c for c in FILTERABLE if c in payload] if filterable is None else filterable
    return write_tables(spark, path, points, about, payload, filterable, dealt=True)


def upsert_collection(spark: SparkSession, col: Collection, docs: DataFrame, path: str | None = None,
                      payload: list[str] = PAYLOAD, **how) -> Collection:
    """A new collection in which ``docs`` replace the points of their ids; an id given twice raises.

    Postings and blocks follow from the points, so terms that a replaced text no longer holds stop
    matching. The IDF is carried on: document frequencies change by the new points' terms and the
    replaced ones', no other posting is counted. Points that stay are copied within their buckets, new ones written
    beside them; only when the buckets became too few are all dealt anew. The old collection stays readable; the new one is
    complete once this returns.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not ids.isEmpty():
        raise ValueError(f"doc_id {ids.first()[0]} is given more than once")
    path = path or scratch_path(spark, "collection")
    m = col.manifest
    new_path = f"{path}/_new"
    dims = {"dense_dim": m["dense_dim"] or represent.DENSE_DIM, "late_dim": m["late_dim"] or represent.LATE_DIM}
    buckets = m["buckets"]
    made = represent.build_points(deal(docs, buckets, "doc_id"), "doc_id", "text", payload=payload, **dims, **how)[0]
    made.write.options(**VECTOR_FILES).parquet(new_path)
    new = spark.read.parquet(new_path)
    n_new = new.count()
    gone = new.select("point_id")
    deltas = document_frequency_deltas(col, new)
    kept = col.points.join(bounded_broadcast(gone, n_new), "point_id", "left_anti").select(*col.points.columns)
    if bucket_count(m["n_points"] + n_new) > 2 * buckets:
        points = kept.drop("bucket")
        points = points.unionByName(new.select(*points.columns))
        return write_tables(spark, path, points, m["n_points"] + n_new, payload, m["filterable"], df_deltas=deltas, old_idf=col.idf)
    with file_by_file(spark):
        write_points(kept, path)
        write_points(new.withColumn("bucket", bucket_of(buckets)).select(*kept.columns), path, "append")
    return write_rest(spark, path, buckets, payload, m["filterable"], df_deltas=deltas, old_idf=col.idf)


def document_frequency_deltas(col: Collection, new: DataFrame) -> DataFrame:
    """(term, delta): how document frequencies change when ``new`` points replace those of their ids.

    Replaced points are read from their buckets only.
    """
    replaced = at_points(new.select("point_id"), col.points, ["terms"], new.count())
    signed = new.select(F.explode("terms").alias("term"), F.lit(1).cast("long").alias("d")).unionAll(
        replaced.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("d")))
    return signed.groupBy("term").agg(F.sum("d").alias("delta")).where("delta != 0")


def write_tables(spark: SparkSession, path: str, points: DataFrame, about: int, payload: list[str],
                 filterable: list[str], dense_dim: int | None = None, late_dim: int | None = None,
                 df_deltas: DataFrame | None = None, old_idf: DataFrame | None = None, dealt: bool = False) -> Collection:
    """Write all tables of a collection from its points (``about`` so many) and publish them by the manifest.

    ``df_deltas`` (term, delta) on ``old_idf``: the document frequencies are carried on instead of counted.
    ``dealt``: the points lie in their buckets' partitions already.
    """
    buckets = bucket_count(about)
    points = represent.packed(points if dealt else deal(points, buckets))
    write_points(points.withColumn("bucket", bucket_of(buckets)), path)
    return write_rest(spark, path, buckets, payload, filterable, dense_dim, late_dim, df_deltas, old_idf)


def write_points(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Points with their ``bucket``, whose rows lie together, below their bucket's directory."""
    (points.sortWithinPartitions("bucket", "point_id").write.options(**VECTOR_FILES).mode(mode).partitionBy("bucket")
     .parquet(f"{path}/points"))


def write_rest(spark: SparkSession, path: str, buckets: int, payload: list[str], filterable: list[str], dense_dim: int | None = None,
               late_dim: int | None = None, df_deltas: DataFrame | None = None, old_idf: DataFrame | None = None) -> Collection:
    """Postings, IDF, blocks and manifest of the points under ``path``; the postings and blocks of a bucket come from its
    file, none is shuffled."""
    p = spark.read.parquet(f"{path}/points")
    # Inverted-index layout: each file holds a bucket's postings sorted by term, so a term filter
    # skips its pages by their min-max statistics, and a hot term lies in every file.
    with file_by_file(spark):
        (represent.exploded(p, keep=filterable).sortWithinPartitions("term", "point_id")
         .write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/postings"))
        blockmax.point_blocks(p).write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/blocks")
    sizes = p.agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.size("terms") > 0).alias("n_sparse"), F.count("dense").alias("n_dense"),
                  F.count_if(F.size("late") > 0).alias("n_late"), F.max(F.size("dense")).alias("dense_dim"),
                  F.max(token_size(p, "late")).alias("late_dim")).first().asDict()
    if df_deltas is None:
        idf = represent.idf_table(spark.read.parquet(f"{path}/postings"), sizes["n_sparse"])
    else:
        n = (F.coalesce("n", F.lit(0).cast("long")) + F.coalesce("delta", F.lit(0).cast("long"))).alias("n")
        idf = represent.idf_of(old_idf.select("term", "n").join(df_deltas, "term", "full").select("term", n).where("n > 0"), sizes["n_sparse"])
    idf.write.mode("errorifexists").parquet(f"{path}/idf")
    sizes["dense_dim"], sizes["late_dim"] = dense_dim or sizes["dense_dim"], late_dim or sizes["late_dim"]
    manifest = {**sizes, "buckets": buckets, "n_blocks": max(1, math.ceil(sizes["n_sparse"] / blockmax.BLOCK_POINTS)),
                "payload": list(payload), "filterable": list(filterable), "tables": list(TABLES)}
    return publish(spark, path, manifest)


def publish(spark: SparkSession, path: str, manifest: dict) -> Collection:
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return open_collection(spark, path)


def ingest_candidates(spark: SparkSession, candidates: DataFrame, path: str | None = None,
                      col: Collection | None = None) -> Collection:
    """Candidate records to a searchable collection: map the payload, make the text, embed, write; with ``col``
    they are upserted into it.

    Payload and text are columns of one pass over the records. An id of n records counts as n times n points, every payload
    with every text of that id; such ids are few and are counted first.
    """
    payload = ["language", "headline", "email", "country", "city", "cv_url"]
    docs = shape.map_candidate(candidates, text=True).select(F.col("candidate_id").alias("doc_id"), *payload, "text").where(F.col("doc_id").isNotNull())
    again = candidates.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not again.isEmpty():
        texts = docs.select("doc_id", "text")
        docs = docs.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(
            docs.drop("text").join(again.select("doc_id"), "doc_id", "left_semi").join(texts, "doc_id"))
    if col is not None:
        return upsert_collection(spark, col, docs, path, payload)
    return write_collection(spark, docs, path, payload)


def open_collection(spark: SparkSession, path: str) -> Collection:
    """The collection under ``path``; without its manifest it was never completed, which raises."""
    try:
        manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise ValueError(f"no complete collection in {path}: it has no manifest") from e
        raise
    points, postings, idf, blocks = (spark.read.parquet(f"{path}/{t}") for t in TABLES)
    points = points.withMetadata("bucket", {"buckets": manifest["buckets"]})
    return Collection(points, postings, idf, path, blocks, manifest)


def copy_collection(spark: SparkSession, col: Collection, path: str) -> Collection:
    """Every table of a collection under another path, in the same layout, the manifest last."""
    with file_by_file(spark):
        write_points(col.points, path)
    for name, table in (("postings", col.postings), ("idf", col.idf), ("blocks", col.blocks)):
        table.write.option("compression", "zstd").mode("errorifexists").parquet(f"{path}/{name}")
    return publish(spark, path, col.manifest)


def with_index(col: Collection, k: int = 10, target: float = ivf.TARGET) -> Collection:
    """The collection with an approximate dense branch: searches without a filter or threshold probe its lists."""
    quantizer = ivf.fit(col.points, k=k, target=target)
    return replace(col, index=ivf.build(col.points, quantizer), quantizer=quantizer)


def check_dims(col: Collection, qs: QuerySet) -> None:
    """Queries of other dimensions than the collection's raise before anything is searched."""
    for name in ("dense_dim", "late_dim"):
        want, got = col.manifest.get(name), qs.dims.get(name)
        if want and got and want != got:
            raise ValueError(f"queries have {name} {got}, the collection {want}")


def resolves(df: DataFrame, where: Column) -> bool:
    """Can the condition be told from the columns of ``df`` alone?"""
    try:
        df.where(where)
        return True
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            return False
        raise


def write_queries(spark: SparkSession, qdf: DataFrame, id_col: str = "item_id", text_col: str = "text",
                  path: str | None = None, **how) -> QuerySet:
    """``how``: dense_dim, late_dim, query_mode, stopwords, embedder of ``represent.build_queries``."""
    return write_query_tables(spark, represent.build_queries(spread(qdf), id_col, text_col, **how)[0], path)


def write_query_tables(spark: SparkSession, queries: DataFrame, path: str | None = None) -> QuerySet:
    path = path or scratch_path(spark, "queries")
    queries.write.mode("errorifexists").parquet(f"{path}/queries")
    q = spark.read.parquet(f"{path}/queries")
    represent.query_terms(q).write.mode("errorifexists").parquet(f"{path}/terms")
    got = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("dense")).alias("dense_dim"),
                F.max(F.size(F.get("late", 0))).alias("late_dim")).first().asDict()
    return QuerySet(q, spark.read.parquet(f"{path}/terms"), got.pop("n"), got)


_CACHE: dict[tuple, tuple[Collection, QuerySet]] = {}


def corpus(spark: SparkSession, sf_dir: str) -> tuple[Collection, QuerySet]:
    """Collection over ``documents`` and query set over ``benchmark``, built
    once per session and data directory."""
    ship_package(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _CACHE:
        docs = document_payload(tables.load(spark, sf_dir, "documents"))
        col = write_collection(spark, docs)
        qs = write_queries(spark, tables.load(spark, sf_dir, "benchmark"))
        _CACHE[key] = (col, qs)
    return _CACHE[key]
