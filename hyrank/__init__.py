"""hyrank: hybrid retrieval (dense, sparse BM25, late interaction, fusion) on Spark.

Corpus and queries are both DataFrames; every strategy is a composition of
score -> rank -> limit -> fuse/rerank expressed with the DataFrame API.
"""

from hyrank.session import get_spark, work_dir

__all__ = ["get_spark", "work_dir"]
