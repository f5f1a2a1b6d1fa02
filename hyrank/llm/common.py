"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import gc
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyrank.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A written table is read back in tasks of at least about so many rows.
ROWS_PER_TASK = 100_000


_CUTS = itertools.count(1)
TIDY_EVERY = 6


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished rounds: its cleaner does so when the driver's JVM has
    collected their plans, which an idle driver may not do for half an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager reliable checkpoint in the shared folder.

    A small table that came out of many shuffle partitions is read back in few tasks, so that later
    shuffles do not write a file for each of its nearly empty partitions.
    """
    work_dir(df.sparkSession)
    out = df.checkpoint()
    if next(_CUTS) % TIDY_EVERY == 0:
        tidy(df.sparkSession)
    return out.coalesce(max(8, out.count() // ROWS_PER_TASK))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (inputs may carry any columns)."""
    name = base
    while name in df.columns:
        name += "_"
    return name


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others out of the way in a struct ``_rest``.

    So a column that the caller happens to call ``score`` or ``size`` never meets an operator's own.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*others) if others else F.lit(None).cast("int")).alias("_rest"))


def unpacked(df: DataFrame, docs: DataFrame, *names: str) -> list[Column]:
    """The columns of ``docs`` in order, from a frame made by ``packed``."""
    return [(F.col(c) if c in names else F.col("_rest").getField(c)).alias(c) for c in docs.columns]


#: Keys of 8 bytes that may be broadcast to filter a table: 32 MB.
FILTER_KEYS = 2_000_000


def few(df: DataFrame, keys: DataFrame, name: str, inside: bool = True) -> DataFrame:
    """Rows of ``df`` whose key is in (or not in) ``keys``, a written table of one column.

    Up to FILTER_KEYS keys filter where the rows are; beyond it the same join is an ordinary one.
    """
    small = keys.limit(FILTER_KEYS + 1).count() <= FILTER_KEYS
    return df.join(F.broadcast(keys) if small else keys, name, "left_semi" if inside else "left_anti")
