"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only. Steps:

1. ``source_targets``: words per source, weights by source order, targets
   by water-filling (no target above ``max_repeat`` times its source).
2. A source's documents fall into blocks by a seeded hash: at most
   ``max_blocks`` of about ``block_words`` words. Blocks are put in a
   seeded random order. A target of e whole passes and a rest takes every
   block e times, then blocks in that order until the rest is reached; the
   one block that crosses it is cut between documents.
3. ``splitting_tree``: the block draws each source owes the whole mix are
   split among output shards by a binary tree. A node hands its left half
   a multivariate-hypergeometric sample of its draws, one source after the
   other (conditional hypergeometric draws by inversion, expanded from the
   mode). Row counts: shards x 1, each with one number per source; nothing
   in it grows with the corpus.
4. A source's draws, in block order, go to shards in the runs that the
   quotas fix, so shards get disjoint draws; within a shard, documents are
   shuffled by a seeded hash.

Documents move once (joined to their draws); all windows run over blocks or
over the one cut block of a source (a ``max_blocks``-th of it), so a hot
source never meets in one task. All draws hash the seed with ids, so reruns
and lost tasks give the same mix.

Null text: size 0, taken 0 words. Null source: a source of its own, last in
order. Sources of size 0 have target 0. Repeated rows are separate
documents, told apart by their content; equal rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyrank.llm.common import cut, fresh, packed, table, unpacked

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 50_000
MAX_BLOCKS = 4096
SHARDS = 16
SWEEPS = 4
SEED = 20_24

#: Spaces are the bytes 20 and 09-0D; dropping a run of other characters to one mark counts words in one pass.
SIZE = ("coalesce(length(translate(regexp_replace(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 'w'), ' \\t\\n\\u000b\\f\\r', '')), 0)")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``size``, the number of words of the whole text."""
    return docs.withColumn("size", F.expr(SIZE).cast("long"))


def source_targets(sized_docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: src (null-safe key), source, source_size, target.

    Water level L: target = min(max_repeat * size, L * weight), summing to
    the total size. In order of cap per weight, a source is capped while the
    level left by those before it reaches its cap.
    """
    per = sized_docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())         # one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1))
    per = per.withColumn("number", F.row_number().over(order)).withColumn("weight", weight)
    per = per.withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows).cast("double")
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # caps hold for a prefix of the order; the first uncapped row's level is everyone's after it
    first_level = F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "number"))
    lv = per.where(~F.col("capped")).agg(first_level.alias("water"))
    out = per.select("source", "source_size", "number", "cap", "weight", "capped", lv.scalar().alias("water"))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("water") * F.col("weight"))
    return out.select("source", "number", "source_size", target.alias("target"))


def _random(*cols):
    """A seeded number in [0, 1) that reruns repeat."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def hypergeometric(total, marked, drawn, u):
    """How many of ``drawn`` items out of ``total`` are among the ``marked``: inversion at ``u`` in [0, 1).

    Probabilities are stepped outward from the mode over 12 deviations (the
    rest is below double precision), then summed from the low end.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    low = F.greatest(F.lit(0.0), d + k - n)
    high = F.least(k, d)
    mode = F.least(high, F.greatest(low, F.floor((d + 1) * (k + 1) / (n + 2)).cast("double")))
    spread = F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * (n - d) / F.greatest(F.lit(1.0), n - 1)))
    reach = F.ceil(12 * spread + 12)
    lo = F.greatest(low, mode - reach).cast("long")
    hi = F.least(high, mode + reach).cast("long")
    at = mode.cast("long")

    def up(x):        # p(x) / p(x - 1)
        return (k - x + 1) * (d - x + 1) / (x * (n - k - d + x))

    def walk(seq, ratio):
        return F.aggregate(seq, F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum")),
                           lambda a, x: F.struct((a["p"] * ratio(x.cast("double"))).alias("p"),
                                                 (a["sum"] + a["p"] * ratio(x.cast("double"))).alias("sum")))

    none = F.array().cast("array<bigint>")
    ups = F.when(hi > at, F.sequence(at + 1, hi)).otherwise(none)
    downs = F.when(lo < at, F.sequence(at, lo + 1, F.lit(-1).cast("long"))).otherwise(none)      # step x -> x - 1
    above, below = walk(ups, up), walk(downs, lambda x: 1 / up(x))
    lowest = below["p"]
    goal = u * (above["sum"] + below["sum"] + 1)
    seq = F.when(hi > lo, F.sequence(lo + 1, hi)).otherwise(none)
    found = F.aggregate(
        seq, F.struct(lowest.alias("p"), lowest.alias("sum"), lo.alias("x")),
        lambda a, x: F.when(a["sum"] > goal, a).otherwise(
            F.struct((a["p"] * up(x.cast("double"))).alias("p"), (a["sum"] + a["p"] * up(x.cast("double"))).alias("sum"), x.alias("x"))))
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(found["x"])


def splitting_tree(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(shard, source number, draws): exact quotas split among ``shards``.

    ``quotas``: one row per source with ``number`` and ``draws``. The tree
    starts with one row that holds all quotas; every level turns a node into
    its halves. Shards get as equal totals as whole numbers allow.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("number", F.col("draws").cast("long").alias("draws")))).alias("left"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("left").alias("own"))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda a, s: a + s["draws"])
    width = 1
    while width < shards:
        width *= 2
        half = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = node.withColumn("half", half).withColumn("n", total)
        share = F.floor(F.col("n") * (F.col("half") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
        node = node.withColumn("share", F.when(F.col("hi") - F.col("lo") > 1, share))
        start = F.struct(F.col("share").alias("due"), F.col("n").alias("pool"),
                         F.array().cast("array<struct<number:int,draws:bigint>>").alias("out"))

        def step(a, s):
            x = hypergeometric(a["pool"], s["draws"], a["due"],
                               _random(F.lit(seed), F.col("lo"), F.col("hi"), s["number"]))
            return F.struct((a["due"] - x).alias("due"), (a["pool"] - s["draws"]).alias("pool"),
                            F.concat(a["out"], F.array(F.struct(s["number"].alias("number"), x.alias("draws")))).alias("out"))

        node = node.withColumn("left", F.when(F.col("share").isNotNull(), F.aggregate("own", start, step)["out"]))
        # written down level by level: the draws of a level are not computed again by the next
        node = cut(node)
        right = F.zip_with("own", "left", lambda o, t: F.struct(o["number"].alias("number"), (o["draws"] - t["draws"]).alias("draws")))
        halves = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "own"))).otherwise(
            F.array(F.struct(F.col("lo"), F.col("half").alias("hi"), F.col("left").alias("own")),
                    F.struct(F.col("half").alias("lo"), F.col("hi"), right.alias("own"))))
        node = node.select(F.explode(halves).alias("h")).select("h.lo", "h.hi", "h.own")
    return node.select(F.col("lo").alias("shard"), F.explode("own").alias("q")).select("shard", "q.number", "q.draws")


def mix(docs: DataFrame, seed: int = SEED, shards: int = SHARDS, block_words: int = BLOCK_WORDS,
        max_blocks: int = MAX_BLOCKS, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``docs`` plus a struct ``mixed``: size, source_size, target, times, and the shards of its draws.

    ``times`` is how often the document is taken, 0 included. Other columns than doc_id,
    text and source must not bear names used here (``packed`` puts any columns out of the way).
    """
    base = sized(docs)
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(("doc_id", "text")) if c in docs.columns])
    base = base.withColumn("_key", key)
    # sizes are counted once; what follows reads three narrow columns
    lean = cut(base.select("_key", "source", "size"))
    targets = cut(source_targets(lean, weights, max_repeat))
    # sources are few rows: recipe-sized
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(max_blocks), F.ceil(F.col("source_size") / block_words))).cast("long")
    plan = targets.select(F.col("source").alias("_source"), "number", "source_size", "target", n_blocks.alias("n_blocks"))
    plan = plan.withColumn("passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)))
    plan = plan.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = _small(plan)

    def placed(df):
        block = F.pmod(F.xxhash64(F.col("_key"), F.lit("block")), F.col("n_blocks"))
        return df.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("block", block)

    lean, docs_plan = placed(lean), placed(base)

    blocks = lean.groupBy("number", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"),
                                                      F.first("rest").alias("rest"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), "number", "block")
    run = Window.partitionBy("number").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("through", F.sum("words").over(run)).withColumn("place", F.row_number().over(run))
    blocks = blocks.withColumn("before", F.col("through") - F.col("words"))
    # whole: all of it in the last pass; cut: the rest ends inside
    blocks = blocks.withColumn("whole", F.col("through") <= F.col("rest"))
    blocks = blocks.withColumn("cut", ~F.col("whole") & (F.col("before") < F.col("rest")))
    blocks = cut(blocks)
    taken, fills = _filled(lean, blocks)
    blocks = blocks.join(_small(fills), ["number", "block"], "left").withColumn("cut", F.col("cut") | F.col("fit").isNotNull())
    blocks = cut(blocks.withColumn("draws", F.col("passes") + F.when(F.col("whole") | F.col("cut"), 1).otherwise(0)))

    # draws of a source, in pass and block order, run through the shards by quota
    quotas = blocks.groupBy("number").agg(F.sum("draws").alias("draws"))
    tree = splitting_tree(quotas, shards, seed)
    ends = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = tree.withColumn("end", F.sum("draws").over(ends)).groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    turn = Window.partitionBy("number").orderBy("pass", "place")
    draws = blocks.where(F.col("draws") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))))
    draws = draws.withColumn("nth", F.row_number().over(turn)).join(_small(bounds), "number")
    shard = F.filter("ends", lambda e: e["end"] >= F.col("nth"))[0]["shard"]
    where = draws.groupBy("number", "block").agg(F.array_sort(F.collect_list(F.struct("pass", shard.alias("shard")))).alias("drawn"))
    flags = blocks.select("number", "block", "cut", "fit").join(where, ["number", "block"], "left")

    keep = [c for c in docs.columns]
    out = docs_plan.join(_small(flags), ["number", "block"], "left").join(_small(taken), ["number", "_key"], "left")
    whole = F.coalesce(F.col("drawn"), F.array().cast("array<struct<pass:bigint,shard:int>>"))
    in_last = F.coalesce(F.col("in_cut"), F.lit(False)) | F.coalesce(F.col("size") <= F.col("fit"), F.lit(False))
    drawn = F.filter(whole, lambda d: (d["pass"] <= F.col("passes")) | ~F.col("cut") | in_last)
    drawn = F.when(F.col("cut").isNull(), F.array().cast("array<struct<pass:bigint,shard:int>>")).otherwise(drawn)
    return out.select(*keep, F.struct("size", "source_size", "target", F.size(drawn).cast("long").alias("times"),
                                      F.transform(drawn, lambda d: d["shard"]).alias("shards")).alias("mixed"))


def _filled(lean: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The last, partial pass beyond its whole blocks: (documents (number, _key, in_cut), blocks (number, block, fit)).

    A cut block gives documents in seeded order as long as they fit, then again over those passed by.
    What it leaves unfilled goes on to the following blocks: of these, documents of at most the words still
    missing count; blocks whose sums fit give all such documents (``fit`` is their largest size), the first that
    does not is cut in turn (``fit`` -1). It ends when nothing is missing or no later document fits.
    """
    at = _small(blocks.where("cut").select("number", "block", "place", (F.col("rest") - F.col("before")).alias("left")))
    places = _small(blocks.select("number", "block", "place"))
    docs, fills = [], []
    in_order = Window.partitionBy("number").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = Window.partitionBy("number").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        fills.append(at.select("number", "block", F.lit(-1.0).alias("fit")))
        taken = lean.join(at, ["number", "block"]).groupBy("number", "_key", "left").agg(F.sum("size").alias("size")).withColumn("in_cut", F.lit(False))
        for _ in range(SWEEPS):
            fits = ~F.col("in_cut") & (F.col("size") <= F.col("left"))
            taken = taken.withColumn("through", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(in_order))
            taken = taken.withColumn("new", fits & (F.col("through") <= F.col("left")))
            used = F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(Window.partitionBy("number"))
            taken = taken.withColumn("left", F.col("left") - used).withColumn("in_cut", F.col("in_cut") | F.col("new"))
        taken = cut(taken.where("in_cut").select("number", "_key", "size", "in_cut"))
        docs.append(taken.select("number", "_key", "in_cut"))
        used = taken.groupBy("number").agg(F.sum("size").alias("used"))
        still = at.join(used, "number", "left").select("number", F.col("place").alias("done"),
                                                       (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"))
        still = _small(still.where("left >= 1"))
        rows = lean.join(still, "number").where((F.col("size") > 0) & (F.col("size") <= F.col("left")))
        sums = rows.join(places, ["number", "block"]).where(F.col("place") > F.col("done")) \
            .groupBy("number", "block", "place", "left").agg(F.sum("size").alias("words"))
        sums = sums.withColumn("through", F.sum("words").over(run)).withColumn("before", F.col("through") - F.col("words"))
        sums = cut(sums.where(F.col("before") < F.col("left")))
        fills.append(sums.where("through <= left").select("number", "block", F.col("left").alias("fit")))
        at = _small(sums.where("through > left").select("number", "block", "place", (F.col("left") - F.col("before")).alias("left")))
        if at.isEmpty():
            return cut(_all(docs)), cut(_all(fills))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Rows of sources, blocks and one cut block per source: bounded by the recipe (sources x max_blocks).
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a written table of recipe size; beyond the bound an ordinary join."""
    df = cut(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def shuffled(mixed: DataFrame, seed: int = SEED, shard_partitions: int | None = None) -> DataFrame:
    """One row per draw, laid out by shard and shuffled inside it; ``shard`` and ``draw`` columns added."""
    rows = mixed.select("*", F.posexplode("mixed.shards").alias("draw", "shard"))
    spot = F.xxhash64(F.lit(seed), F.lit("spot"), "shard", "draw", "doc_id", "text")
    return rows.repartition(*([shard_partitions] if shard_partitions else []), "shard", F.pmod(spot, F.lit(8))) \
        .sortWithinPartitions("shard", spot)


def op8(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mixed.size").alias("size"), F.col("mixed.source_size").alias("source_size"),
                      F.col("mixed.target").alias("target"),
                      (F.col("mixed.times") * F.col("mixed.size")).alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: one row per draw, with its shard."""
    names = ("doc_id", "text", "source")
    drawn = mix(packed(docs, *names))
    return drawn.select(*unpacked(drawn, docs, *names), F.explode("mixed.shards").alias(fresh(docs, "shard")))
