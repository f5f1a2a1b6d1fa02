"""What writing, copying and upserting a collection moves."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from hyrank.operators import blockmax, represent, retrieve
from hyrank.plans import collection as PC
from hyrank.session import scratch_path


def docs(spark, n=4000, words=60):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(j)}" for j in rng.integers(0, 300, words)), "en") for i in range(n)]
    return spark.createDataFrame(rows + [(n, None, "en"), (n + 1, "", "fr")], "doc_id long, text string, lang string")


def test_a_files_dictionary_holds_each_token_vector_once(spark):
    col = PC.write_collection(spark, docs(spark), scratch_path(spark, "t"), payload=["lang"])
    one = glob.glob(f"{col.path.removeprefix('file:')}/points/**/*.parquet", recursive=True)[0]
    group = pq.ParquetFile(one).metadata.row_group(0)
    late = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("late"))
    assert late.total_uncompressed_size < late.num_values * 64 / 3          # 64 bytes a vector, 300 different ones
    assert col.manifest["late_dim"] == represent.LATE_DIM


def test_postings_and_blocks_of_points_are_not_shuffled(spark):
    col = PC.write_collection(spark, docs(spark, 600), scratch_path(spark, "t"), payload=["lang"])
    p = blockmax.point_blocks(col.points)
    assert "Exchange" not in p._jdf.queryExecution().executedPlan().toString()
    ids = [r.ids for r in p.select(F.explode("entries").alias("e")).select("e.*").where("term is null").collect()]
    assert sorted(sum(ids, [])) == list(range(600))


def test_blocks_keep_rows_of_one_id_together(spark):
    points, _ = represent.build_points(docs(spark, 300).where("text is not null"))
    twice = points.unionByName(points).repartition(1).sortWithinPartitions("point_id")
    for size in (1, 7, 64):
        ids = [r.ids for r in blockmax.point_blocks(twice, size).select(F.explode("entries").alias("e")).select("e.*").where("term is null").collect()]
        assert sorted(sum(ids, [])) == list(range(300))


def test_copy_and_upsert_stay_in_their_buckets(spark, monkeypatch):
    col = PC.write_collection(spark, docs(spark, 600), scratch_path(spark, "t"), payload=["lang"])
    # only new texts are dealt; what is there is copied where it lies
    dealt = []
    was = PC.deal
    monkeypatch.setattr(PC, "deal", lambda df, *a: dealt.append(df.count()) or was(df, *a))
    copied = PC.copy_collection(spark, col, scratch_path(spark, "t"))
    new = spark.createDataFrame([(5, "fresh words", "en"), (9999, "w1 fresh", "fr")], "doc_id long, text string, lang string")
    up = PC.upsert_collection(spark, copied, new, scratch_path(spark, "t"), payload=["lang"])
    assert dealt == [2]
    whole = docs(spark, 600).where("doc_id <> 5").unionByName(new)
    monkeypatch.undo()
    want = PC.write_collection(spark, whole, scratch_path(spark, "t"), payload=["lang"])
    for name in ("postings", "idf"):
        a, b = (sorted(map(str, getattr(c, name).select(sorted(want.postings.columns if name == "postings" else want.idf.columns)).collect())) for c in (up, want))
        assert a == b, name
    assert {k: v for k, v in up.manifest.items()} == want.manifest
    _, terms = represent.build_queries(spark.createDataFrame([(1, "fresh w1 w2")], "item_id long, text string"))
    found = [sorted(map(tuple, blockmax.blockmax_topk(c.blocks, c.idf, terms, 10).collect())) for c in (up, want)]
    assert found[0] == found[1]
    assert sorted(map(tuple, retrieve.sparse_topk(up.postings, up.idf, terms, 10).collect())) == found[0]
    assert len(glob.glob(f"{up.path.removeprefix('file:')}/points/bucket=*")) == up.manifest["buckets"]


def test_sliced_batches_hold_a_bounded_number_of_tokens():
    import pyarrow as pa
    from hyrank.functions import kernels
    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([["a"] * (i % 7) for i in range(100)])], names=["id", "t"])
    parts = list(kernels.sliced(b, "t", 10))
    assert sum(p.num_rows for p in parts) == 100 and len(parts) > 20
    assert all(p.num_rows == 1 or sum(map(len, p.column("t").to_pylist())) <= 10 for p in parts)
