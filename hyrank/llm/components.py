"""Connected components of links, and of links still to be found inside candidate lists.

``connected_components`` alternates large-star and small-star.

Each star step is a grouped minimum (combined map-side) joined back to the
edges, so a hub of any degree splits like any skewed join. Rounds are cut
with reliable checkpoints; the count and a checksum of the edges tell when
nothing moves. Only these two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyrank.llm.common import ROWS_PER_TASK, cut


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """Few tasks for few rows, behind a shuffle too: its next shuffle then writes no file for each of many nearly empty partitions."""
    return df.coalesce(max(8, rows // ROWS_PER_TASK))


def _stamp(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = narrow(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n)
    return narrow(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                  .where(F.col("a") != F.col("b")), n)


def _small_star(e: DataFrame, n: int) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = narrow(down.groupBy("u").agg(F.min("v").alias("m")), n)
    inner = narrow(down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")), n)
    return inner.unionAll(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns a, b): the smallest id that links reach."""
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _stamp(e)
    while seen[0]:
        e = cut(_small_star(cut(_large_star(e, seen[0])), seen[0]))
        now = _stamp(e)
        if now == seen:
            break
        seen = now
    return cut(e.select(F.col("a").alias("id"), F.col("b").alias("component"))
               .unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())


def distinct_lists(lists: DataFrame, *kind: str) -> DataFrame:
    """(token, times): of the lists with the same members (and ``kind``) the least token, and how many such lists there are.

    Near copies share many keys with one and the same list; its pairs are made once. Lists of one member are left out.
    ``lists`` holds a class once in a list. Members are told apart by two 64-bit hashes and their number.
    """
    per = lists.groupBy("token", *kind).agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("cls")).alias("x"),
                                            F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y"))
    same = per.where("size > 1").groupBy("size", "x", "y", *kind).agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("times"))
    return same.select("token", "times")


def contracted(labels: DataFrame) -> DataFrame:
    """Links that say what ``labels`` say: one from each node to its component. With new links beside them
    components are found in few rounds, whatever links the labels came from."""
    return labels.where(F.col("id") != F.col("component")).select(F.col("id").alias("a"), F.col("component").alias("b"))


def star_components(lists: DataFrame, fits, verify, links: DataFrame | None = None, checked: DataFrame | None = None, rounds: int = 2):
    """Components of the links inside candidate lists, found by stars instead of all pairs.

    ``lists``: (token, cls, info); ``fits(info, info)``: a cheap condition any
    link meets; ``verify``: pairs (a, b) -> those that link. Each round
    compares the members of a list with one hub of it. ``links`` and ``checked``:
    what is known from elsewhere. Returns (labels
    (id, component), links that say the same, checked pairs, lists that still span components).
    """
    labels = None if links is None else connected_components(links)
    live = lists.withColumn("component", F.col("cls")) if links is None else cut(live_lists(lists, labels))
    for r in range(rounds):
        # first the hub with the least of its own beside what the list shares (``info`` leads with a size), then another
        pick = F.min(F.struct("info", "cls", "component")) if r == 0 else F.max(F.struct("cls", "info", "component"))
        hub = narrow(live.groupBy("token").agg(pick.alias("hub")), live.count())
        pairs = live.join(hub, "token").where((F.col("hub.component") != F.col("component")) & fits(F.col("info"), F.col("hub.info")))
        pairs = pairs.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b")).distinct()
        pairs = cut(pairs if checked is None else pairs.join(checked, ["a", "b"], "left_anti"))
        good = cut(verify(pairs))
        checked = pairs if checked is None else cut(checked.unionAll(pairs))
        labels = connected_components(good if labels is None else contracted(labels).unionAll(good))
        live = cut(live_lists(lists, labels))
    return labels, contracted(labels), checked, live


def live_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """List entries with their components; lists inside one component are dropped."""
    e = lists.join(labels.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    span = e.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    return e.join(span.select("token"), "token", "left_semi")


def cross_pairs(live: DataFrame, fits, checked: DataFrame) -> DataFrame:
    """Unchecked pairs of different components that share a list and fit."""
    a = live.select("token", F.col("cls").alias("a"), F.col("info").alias("ia"), F.col("component").alias("ca"))
    b = live.select("token", F.col("cls").alias("b"), F.col("info").alias("ib"), F.col("component").alias("cb"))
    pairs = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits(F.col("ia"), F.col("ib")))
    return pairs.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
