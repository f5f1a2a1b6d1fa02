"""Relevance evaluation (V1-V4): compare strategies side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the words the searched system counts as relevant.
RELEVANCE_WORDS = ("test", "qa")
#: Steps of a running sum that one window takes.
STEPS = 1024


def relevance_flag(hits: DataFrame, text_col: str = "headline", words=RELEVANCE_WORDS) -> DataFrame:
    """V1: lower(text) contains any word (substring, not whole word)."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    flag = None
    for w in words:
        c = low.contains(w)
        flag = c if flag is None else (flag | c)
    return hits.withColumn("relevant", flag)


def hits_at_cutoffs(hits: DataFrame, every: int = 50, group=("query_id", "method")) -> DataFrame:
    """V2: relevant hits among the first n results, for n = every, 2*every, ...

    Hits are first summed up by steps of ``every`` ranks (combined map-side). The running sum over the steps is taken
    in two levels, runs of STEPS steps and what lies before a run, so no task holds a long list.
    """
    step = F.floor((F.col("rank") - 1) / every).cast("long")
    steps = hits.groupBy(*group, step.alias("_step")).agg(F.sum(F.col("relevant").cast("long")).alias("_own"), F.max("rank").alias("_last"))
    steps = steps.withColumn("_run", F.floor(F.col("_step") / STEPS).cast("long"))
    inside = Window.partitionBy(*group, "_run").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = steps.groupBy(*group, "_run").agg(F.sum("_own").alias("_sum"))
    runs = runs.select(*group, "_run", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_before"))
    out = steps.withColumn("_rel", F.sum("_own").over(inside)).join(runs, [*group, "_run"])
    out = out.where(F.col("_last") == (F.col("_step") + 1) * every).withColumn("_rel", F.col("_rel") + F.col("_before"))
    return out.select(*group, F.col("_last").cast("long").alias("cutoff"),
                      F.col("_rel").cast("long").alias("relevant"),
                      (F.round(F.col("_rel") / F.col("_last"), 6) + 0.0).alias("ratio"))


def total_results(hits: DataFrame, group=("query_id", "method")) -> DataFrame:
    """V3: number of results per ranked list."""
    return hits.groupBy(*group).agg(F.count(F.lit(1)).cast("long").alias("total"))


def compare_methods(method_hits: dict[str, DataFrame], every: int = 50, points: DataFrame | None = None,
                    text_col: str = "headline", words=RELEVANCE_WORDS, hit_bound: int | None = None) -> DataFrame:
    """V4: all strategies on the same queries -> hit rate at every cutoff.

    Hits either carry ``relevant`` already, or ``points`` is given: then the
    hit lists are unioned first and the payload is joined (and flagged) once.
    """
    allh = None
    for name, h in method_hits.items():
        cols = ["query_id", "point_id", "rank"] + (["relevant"] if points is None else [])
        part = h.select(*cols).withColumn("method", F.lit(name))
        allh = part if allh is None else allh.unionByName(part)
    if points is not None:
        from hyrank.operators.shape import project_hits
        allh = relevance_flag(project_hits(allh, points, [text_col], hit_bound), text_col, words)
    cut = hits_at_cutoffs(allh, every)
    return cut.groupBy("method", "cutoff").agg(
        F.count(F.lit(1)).cast("long").alias("queries"),
        F.sum("relevant").cast("long").alias("relevant"),
        (F.round(F.sum("relevant") / (F.col("cutoff") * F.count(F.lit(1))), 6) + 0.0).alias("ratio"))
