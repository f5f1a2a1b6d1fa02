"""The embedding job: each text once, failures set aside, nothing embedded again."""

import os
import sys

from pyspark import cloudpickle

from hyrank import api
from hyrank.operators import embedding
from hyrank.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])        # workers cannot import this file


def counting(folder, bad=("poison",), flaky=False):
    """An embedder that leaves a file for every text it is asked for."""
    def make():
        import uuid
        failed = set()

        def embed(texts):
            for t in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            if any(t in bad for t in texts):
                raise RuntimeError("the model gave up")
            if flaky and texts[0] not in failed:
                failed.add(texts[0])
                raise TimeoutError("try again")
            return [([float(len(t)), 1.0], [[1.0, float(len(t))]]) for t in texts]
        return embed
    return make


def asked(folder):
    return sorted(open(f"{folder}/{f}").read() for f in os.listdir(folder))


def test_each_new_text_once_and_rejects(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two two"), (3, "one"), (4, None), (5, "poison"), (6, "")], "point_id long, text string")
    cache = scratch_path(spark, "cache")
    a = tmp_path / "a"
    a.mkdir()
    vectors, rejects = embedding.embed_texts(docs, cache, counting(str(a)), batch=1, attempts=2)
    assert {r.point_id: r.dense for r in vectors.collect()} == {1: [3.0, 1.0], 2: [7.0, 1.0], 3: [3.0, 1.0], 6: [0.0, 1.0]}
    assert [(r.point_id, r.error) for r in rejects.collect()] == [(5, "RuntimeError: the model gave up")]
    assert asked(a) == sorted(["", "one", "two two"] + ["poison"] * 4)             # its batch twice, then the text itself twice

    b = tmp_path / "b"
    b.mkdir()
    more = docs.unionAll(spark.createDataFrame([(7, "three"), (8, "two two")], docs.schema))
    vectors, rejects = embedding.embed_texts(more, cache, counting(str(b), bad=()))
    assert sorted(r.point_id for r in vectors.collect()) == [1, 2, 3, 5, 6, 7, 8] and rejects.isEmpty()
    assert asked(b) == ["poison", "three"]
    assert sorted((r.embedded, r.rejected) for r in embedding.embed_counts(cache, spark).collect()) == [(2, 0), (3, 1)]


def test_one_bad_text_does_not_take_its_batch_along(spark, tmp_path):
    docs = spark.createDataFrame([(i, "poison" if i == 30 else f"text {i}") for i in range(60)], "point_id long, text string").coalesce(1)
    vectors, rejects = embedding.embed_texts(docs, scratch_path(spark, "cache"), counting(str(tmp_path)))
    assert vectors.count() == 59 and [r.point_id for r in rejects.collect()] == [30]


def test_passing_failures_are_tried_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "point_id long, text string")
    vectors, rejects = embedding.embed_texts(docs, scratch_path(spark, "cache"), counting(str(tmp_path), flaky=True))
    assert vectors.count() == 2 and rejects.isEmpty()


class Constant:
    def __init__(self, dim):
        self.dim = dim

    def vectors(self, tokens):
        import numpy as np
        return np.array([[1.0 + len(t), *([1.0] * (self.dim - 1))] for t in tokens]).reshape(len(tokens), self.dim)


def test_token_embedder_and_stopwords_reach_the_collection(spark):
    docs = spark.createDataFrame([(1, "the fish"), (2, "the tree house")], "doc_id long, text string")
    col = api.build_collection(spark, docs, dense_dim=4, late_dim=2, embedder=Constant, stopwords=["the"])
    assert (col.manifest["dense_dim"], col.manifest["late_dim"]) == (4, 2)
    assert {r.term for r in col.postings.collect()} == {"fish", "tree", "house"}
    raw = {r.point_id: r.dense for r in col.points.collect()}
    assert abs(raw[1][0] / raw[1][1] - (4 + 5) / 2) < 1e-5
    qs = api.build_query_set(spark, docs.withColumnRenamed("doc_id", "query_id"), dense_dim=4, late_dim=2, embedder=Constant, query_mode="unit",
                             stopwords=["the"])
    assert {r.qweight for r in qs.terms.collect()} == {1.0}
    assert api.search(col, qs, "rrf_all", 2).count() == 4


def test_idf_counts_its_points_without_tokenising_again(spark):
    from hyrank.operators import represent
    docs = spark.createDataFrame([(1, "a b a"), (2, "B"), (3, "..."), (4, None), (5, ""), (6, "Ünder_score 7"), (6, "twice")], "point_id long, text string")
    post = represent.bm25_weights(docs)
    quick = represent.idf_table(post, represent.n_with_terms(docs))
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, represent.idf_table(post).collect()))
    assert quick._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
