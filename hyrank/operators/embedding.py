"""E1/E4 as a job: embed only texts never embedded before, and set aside those that fail.

``embed_texts`` keeps a cache of vectors by the SHA-256 of the text. Known
hashes are taken out by an anti-join; the rest are embedded once a text, however many rows have it. The
embedder runs in the tasks, a batch of texts at a time. A batch that fails is tried again, then text by text; a text that
still fails becomes a row of the reject table with its error, and the job goes on.

The cache and the reject table are Parquet folders that runs append to. Spark publishes a run's files when its
job ends, so a run that dies half way leaves no half batch behind; a text embedded twice (two runs
at a time) has equal vectors, and one of them is read. Rejected texts are tried again by the next run.

Null texts have no vector and are not rejected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTORS = "key string, dense array<float>, late array<array<float>>"
RESULT = VECTORS + ", error string"
REJECTS = "run string, key string, error string"
BATCH = 64
ATTEMPTS = 3


def text_key(text: str = "text"):
    return F.sha2(F.col(text), 256)


def embedded(texts: DataFrame, make_embedder: Callable, batch: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """(key, dense, late, error) of (key, text) rows. ``make_embedder()`` is called once a task and gives a
    function: list of texts -> list of (dense vector or None, list of token vectors or None)."""
    def run(batches):
        import pyarrow as pa
        embed = make_embedder()
        schema = pa.schema([("key", pa.string()), ("dense", pa.list_(pa.float32())), ("late", pa.list_(pa.list_(pa.float32()))),
                            ("error", pa.string())])

        def tried(texts):
            for n in range(attempts):
                try:
                    return embed(texts), None
                except Exception as e:  # noqa: BLE001  whatever a model raises ends in the reject table
                    error = f"{type(e).__name__}: {e}"[:500]
            return None, error

        for b in batches:
            keys, texts = b.column("key").to_pylist(), b.column("text").to_pylist()
            for lo in range(0, len(keys), batch):
                some, own = texts[lo:lo + batch], keys[lo:lo + batch]
                got, error = tried(some)
                if error is None:
                    rows = [(k, d, t, None) for k, (d, t) in zip(own, got)]
                else:
                    rows = []
                    for k, text in zip(own, some):
                        one, error = tried([text])
                        rows.append((k, *(one[0] if error is None else (None, None)), error))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts.select("key", "text").mapInArrow(run, RESULT)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder that runs append to; none before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def embed_texts(rows: DataFrame, cache: str, make_embedder: Callable, id_col: str = "point_id", text_col: str = "text",
                batch: int = BATCH, attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(vectors (id, dense, late), rejects (id, error)) of all rows; only texts whose hash is not in ``cache`` are embedded."""
    spark = rows.sparkSession
    run = uuid.uuid4().hex
    keyed = rows.select(F.col(id_col), F.col(text_col).alias("text"), text_key(text_col).alias("key")).where(F.col("text").isNotNull())
    known = _table(spark, f"{cache}/vectors", VECTORS)
    new = keyed.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.any_value("text").alias("text"))
    # one pass over the model: what came of it is written, then told apart
    out = f"{cache}/runs/{run}"
    embedded(new, make_embedder, batch, attempts).write.parquet(out)
    done = spark.read.schema(RESULT).parquet(out)
    done.where("error is null").drop("error").write.mode("append").parquet(f"{cache}/vectors")
    done.where("error is not null").select(F.lit(run).alias("run"), "key", "error").write.mode("append").parquet(f"{cache}/rejects")
    vectors = _table(spark, f"{cache}/vectors", VECTORS).dropDuplicates(["key"])
    rejects = _table(spark, f"{cache}/rejects", REJECTS).where(F.col("run") == run)
    ids = keyed.select(id_col, "key")
    return ids.join(vectors, "key").drop("key"), ids.join(rejects.select("key", "error"), "key").drop("key")


def embed_counts(cache: str, spark: SparkSession) -> DataFrame:
    """(run, embedded, rejected): what each run did."""
    done = spark.read.option("basePath", f"{cache}/runs").schema(RESULT).parquet(f"{cache}/runs/*")
    run = F.regexp_extract(F.input_file_name(), r"/runs/([0-9a-f]+)/", 1)
    return done.groupBy(run.alias("run")).agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("rejected"))
