"""Versioned tables: crashes between data and log, replays, payloads with maps."""

import pytest
from pyspark.sql import functions as F

from hyrank import api
from hyrank.session import scratch_path
from hyrank.sources import collection_ops as CO


def _table(spark, rows):
    return spark.createDataFrame(rows, "point_id long, source string, seq long")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unlogged_directory_does_not_block_the_next_commit(spark):
    base = scratch_path(spark, "crash")
    tbl = CO.VersionedTable(spark, base)
    tbl.commit(_table(spark, [(1, "a", 1)]))
    _table(spark, [(9, "lost", 9)]).write.parquet(f"{base}/data-of-a-crashed-writer")
    tbl.upsert(_table(spark, [(2, "b", 1)]))
    assert _rows(tbl.read()) == [(1, "a", 1), (2, "b", 1)]
    assert tbl.current_version() == 2 and _rows(tbl.read(1)) == [(1, "a", 1)]


def test_old_batch_replayed_over_a_newer_one_changes_nothing(spark):
    target = _table(spark, [(1, "a", 1), (5, "z", 1)])
    new, old = _table(spark, [(1, "c", 3)]), _table(spark, [(1, "b", 2)])
    once = CO.upsert_points(CO.upsert_points(target, old), new)
    again = CO.upsert_points(once, old)
    assert _rows(once) == _rows(again) == [(1, "c", 3), (5, "z", 1)]


def test_payload_with_a_map(spark):
    df = spark.createDataFrame([(1, {"en": "x"}, 1), (1, {"en": "y"}, 2), (2, None, 1)], "point_id long, bio map<string,string>, seq long")
    got = {r.point_id: r.bio for r in CO.dedupe_latest(df).collect()}
    assert got == {1: {"en": "y"}, 2: None}


def test_broken_log_is_an_error_not_an_empty_table(spark):
    base = scratch_path(spark, "broken")
    spark.createDataFrame([("x",)], "t string").write.text(f"{base}/_log")
    with pytest.raises(Exception):
        CO.VersionedTable(spark, base).current_version()


def test_pages_follow_one_another_to_the_end(spark):
    docs = spark.range(25).select(F.col("id").alias("doc_id"), F.concat(F.lit("same word number"), F.col("id").cast("string")).alias("text"))
    col = api.build_collection(spark, docs)
    qs = api.build_query_set(spark, spark.createDataFrame([(0, "word")], "query_id long, text string"))
    pages = [[r.point_id for r in api.search_page(col, qs, "sparse", p).orderBy("rank").collect()] for p in range(4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert len({x for p in pages for x in p}) == 25
