"""embed_late: tokens and vectors in one pass, without a shuffle of vectors; rows as by a join on the id."""

from pyspark.sql import functions as F

from hyrank.functions.text import tokens
from hyrank.operators import represent as R
from hyrank.plans import registry


def _joined(docs):
    toks = docs.select("point_id", F.array_distinct(tokens("text")).alias("toks"))
    z = toks.join(R.embed_late(docs), "point_id").select("point_id", F.explode(F.arrays_zip("toks", "late")).alias("z"))
    return z.select("point_id", F.col("z.toks").alias("term"),
                    *[(F.round(F.col("z.late")[i].cast("double"), 6) + 0.0).alias(f"v{i}") for i in range(R.LATE_DIM)])


def _sorted(df):
    return sorted(map(str, df.collect()))


def test_vectors_are_not_shuffled(spark):
    docs = spark.createDataFrame([(n, f"some words {n} of été and words") for n in range(30)] + [(99, None), (98, "")], "point_id long, text string")
    out = registry._late_rows(docs)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert _sorted(out) == _sorted(_joined(docs)) and out.count() > 100


def test_ids_of_several_documents_stay_as_they_were(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "d e"), (2, "f g"), (3, None), (3, "h"), (4, "i"), (4, "i")], "point_id long, text string")
    assert _sorted(registry._late_rows(docs)) == _sorted(_joined(docs))
