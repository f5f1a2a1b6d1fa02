"""User-facing entry points: build once, search many times.

    from hyrank import api
    spark = api.get_spark()
    col = api.build_collection(spark, docs_df, id_col="doc_id", text_col="text", payload=["title"])
    qs = api.build_query_set(spark, queries_df, id_col="qid", text_col="text")
    hits = api.search(col, qs, "rrf_dense_sparse", k=10, where=F.col("lang") == "en", payload=["title"])
    page3 = api.search_page(col, qs, "rrf_dense_sparse", 2)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyrank.operators import retrieve, shape
from hyrank.plans import strategies
from hyrank.plans.collection import (Collection, QuerySet, check_dims, copy_collection, ingest_candidates, open_collection, spread,
                                     upsert_collection, with_index, write_collection, write_queries, write_query_tables, write_tables)
from hyrank.session import get_spark, ship_package

METHODS = tuple(strategies.STRATEGIES)

__all__ = ["get_spark", "build_collection", "build_collection_from_vectors", "open_collection", "ingest_candidates", "upsert",
           "build_query_set", "build_query_set_from_vectors", "copy_collection", "with_index",
           "search", "search_page", "page", "METHODS"]


def build_collection(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     payload: list[str] = (), path: str | None = None, filterable: list[str] = (),
                     **how) -> Collection:
    """Ingest a corpus: points (payload, sparse, dense, late), postings, blocks, IDF and manifest, written once.

    ``filterable``: payload that postings carry too, so that search filters on it reach their scan.
    ``how``: dense_dim, late_dim, stopwords.
    """
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *payload)
    return write_collection(spark, spread(base), path, payload=list(payload), filterable=list(filterable), **how)


def build_query_set(spark: SparkSession, queries: DataFrame, id_col: str = "query_id",
                    text_col: str = "text", **how) -> QuerySet:
    """Embed a query table with the same (document-mode) representations; ``how``: dense_dim, late_dim,
    query_mode, stopwords."""
    ship_package(spark)
    return write_queries(spark, queries, id_col, text_col, **how)


def build_query_set_from_vectors(spark: SparkSession, queries: DataFrame, text_col: str | None = None) -> QuerySet:
    """Queries whose vectors were computed elsewhere: ``query_id``, ``dense`` and ``late`` (either may be null), L2-normalised
    here as the points are; sparse terms come from ``text_col`` when given."""
    from hyrank.operators import represent
    ship_package(spark)
    q = represent.normalize_vectors(queries, ["dense"], ["late"])
    q = q.select("query_id", F.col("dense").cast("array<float>").alias("dense"), F.col("late").cast("array<array<float>>").alias("late"),
                 *([F.col(text_col).alias("text")] if text_col else []))
    return write_query_tables(spark, represent.with_sparse(q, "query_id", "text" if text_col else None))


def upsert(spark: SparkSession, col: Collection, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           payload: list[str] = (), path: str | None = None) -> Collection:
    """A new collection with ``docs`` (one row per id) in place of the points of their ids."""
    ship_package(spark)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *payload)
    return upsert_collection(spark, col, base, path, list(payload))


def search(col: Collection, qs: QuerySet, method: str = "rrf_dense_sparse", k: int | None = 10,
           where: Column | None = None, payload: list[str] = (), **params) -> DataFrame:
    """Run one of METHODS for every query; ``where`` filters the points before
    scoring; ``payload`` columns are joined after the top-k (vectors never read)."""
    if method not in strategies.STRATEGIES:
        raise ValueError(f"unknown method {method!r}; choose from {METHODS}")
    check_dims(col, qs)
    hits = strategies.STRATEGIES[method](col, qs, k, where=where, **params)
    if payload:
        bound = qs.n * k if k is not None else None
        hits = shape.project_hits(hits, col.points, list(payload), hit_bound=bound)
    return hits


def search_page(col: Collection, qs: QuerySet, method: str = "rrf_dense_sparse", page_no: int = 0,
                size: int = strategies.PAGE_SIZE, **params) -> DataFrame:
    """Page ``page_no`` (0-based) of a search. The ranking is cut at the page's
    end, so pages follow one another until the matches are used up."""
    return retrieve.page_hits(search(col, qs, method, k=(page_no + 1) * size, **params), page_no, size)


def page(hits: DataFrame, page_no: int, size: int = strategies.PAGE_SIZE) -> DataFrame:
    """Page ``page_no`` (0-based) of a hit list searched with ``k=None`` or a k beyond
    the page's end; ``search_page`` sees to that by itself."""
    return retrieve.page_hits(hits, page_no, size)


def build_collection_from_vectors(spark: SparkSession, points: DataFrame, dense_dim: int, late_dim: int,
                                  text_col: str | None = None, payload: list[str] = (),
                                  path: str | None = None) -> tuple[Collection, DataFrame]:
    """Ingest points whose vectors were computed elsewhere (``point_id``,
    ``dense`` array, ``late`` array of arrays, payload, optional text).

    Rows violating the declared dimensions are returned as ``rejected`` (with
    a reason) instead of being written; the rest are L2-normalised once, at
    write time, and BM25 postings are built from ``text_col`` when given.
    """
    from hyrank.operators import represent
    from hyrank.session import scratch_path
    from hyrank.sources.collection_ops import validate_vectors
    ship_package(spark)
    path = path or scratch_path(spark, "collection")
    valid, rejected = validate_vectors(points, dense_dim, late_dim)
    norm = represent.normalize_vectors(valid, ["dense"], ["late"])
    norm = norm.select("point_id", *payload,
                       F.col("dense").cast("array<float>").alias("dense"),
                       F.col("late").cast("array<array<float>>").alias("late"),
                       *([F.col(text_col).alias("_text")] if text_col else []))
    full = represent.with_sparse(norm, "point_id", "_text" if text_col else None).drop("_text")
    return write_tables(spark, path, full, points.count(), list(payload), [], dense_dim, late_dim), rejected
