"""Mixing sources to target weights with a hypergeometric splitting tree (operator 9).

DataFrame functions only.  Each source's documents are dealt into blocks by a
seeded hash, which permutes them.  A source takes each of its blocks
``floor(target / size)`` times and, of one more round, a prefix of the
permuted blocks up to the exact remainder; inside the block where the
remainder ends, single documents are taken in permuted order.  The block
draws of all sources are then split among output shards by a binary tree: at
each node the left half gets a multivariate hypergeometric sample of the
sources' quotas (an urn is drawn from, one block at a time, with hashed
uniforms), down to exact quotas for each (shard, source).  Shards take
disjoint runs of each source's permuted draws.  ``orders`` has a seeded hash for
each draw of a document; ``draws`` deals the draws to their shards and shuffles
each locally by it, and ``write_shards`` writes them as files in that order.

Work on documents is one hash aggregation by (source, block), a window inside
the one cut block of each source, an aggregation for the document that fills
the last gap, and a join with the plan; all else is on at most ``blocks`` rows
per source.

Defined cases: null text has size 0; null source is a source of its own,
last; a source of size 0 has target 0 and takes nothing; repeated rows are
documents of their own, taken together or not at all in a cut; other columns
are carried, ones named as the results are replaced; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored

RESULTS = ("size", "source_size", "target", "copies", "taken", "shards", "orders")
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_times: float = 3.0) -> DataFrame:
    """Targets of sources (source, source_size): shares by weight, held to most_times the source's size, the excess reshared.

    The level L with sum(min(L * weight, cap)) = total is found from running
    sums over the sources in the order of cap / weight; no iteration.
    """
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most_times)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    # the first source that stays below its cap sets the level for all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    rows = rows.withColumn("level", level)
    target = F.when(F.col("level").isNull() | (F.col("level") >= F.col("ratio")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    return (F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))


def _halve(nodes: DataFrame, level: int, seed: int, item: str) -> DataFrame:
    """Each node's left and right half."""
    total = F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + x["quota"])

    def draw(state: Column, x: Column) -> Column:
        # an urn of state.rest blocks of which state.room go left: how many of this source's quota do?
        def one(s: Column, k: Column) -> Column:
            left = _uniform(F.lit(seed), F.lit(level), s["node"], x["source"], k) * s["rest"] < s["room"]
            return F.struct(s["node"].alias("node"), (s["rest"] - 1).alias("rest"), (s["room"] - left.cast("long")).alias("room"), (s["got"] + left.cast("long")).alias("got"))

        start = F.struct(state["node"].alias("node"), state["rest"].alias("rest"), state["room"].alias("room"), F.lit(0).cast("long").alias("got"))
        steps = F.when(x["quota"] > 0, F.sequence(F.lit(1).cast("long"), x["quota"])).otherwise(F.array().cast("array<bigint>"))
        end = F.aggregate(steps, start, one)
        got = F.struct(x["source"].alias("source"), end["got"].alias("quota"))
        return F.struct(end["node"].alias("node"), end["rest"].alias("rest"), end["room"].alias("room"), F.concat(state["left"], F.array(got)).alias("left"))

    start = F.struct(F.col("shard").alias("node"), total.alias("rest"), F.floor((total + 1) / 2).cast("long").alias("room"), F.array().cast(f"array<{item}>").alias("left"))
    left = F.aggregate("items", start, draw)["left"]
    halves = nodes.withColumn("left", left).withColumn("right", F.zip_with("items", "left", lambda a, b: F.struct(a["source"].alias("source"), (a["quota"] - b["quota"]).alias("quota"))))
    return halves.select(F.posexplode(F.array("left", "right")).alias("side", "items"), "shard").select((F.col("shard") * 2 + F.col("side")).alias("shard"), "items")


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(source, shard, quota, first): exact quotas of 2**levels shards, and the rank of each shard's first draw in its source."""
    item = "struct<source:string,quota:bigint>"
    nodes = quotas.select(F.struct("source", "quota").alias("item")).agg(F.sort_array(F.collect_list("item")).alias("items")).select(F.lit(0).cast("long").alias("shard"), "items")
    for level in range(levels):
        nodes = _halve(nodes, level, seed, item)
    leaves = nodes.select("shard", F.explode("items").alias("x")).select("shard", "x.source", "x.quota")
    run = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("quota").over(run), F.lit(0)).cast("long"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most_times: float = 3.0, shard_levels: int = 3, blocks: int = 1024, seed: int = 7, broadcast_sources: int = 200) -> DataFrame:
    """docs with size, source_size, target, copies, taken (copies * size), and shards and orders: each copy's shard and its place there.

    The plan has a row per source and block.  With up to broadcast_sources sources, counted here from the source
    column alone, it has at most broadcast_sources * blocks rows and is broadcast; with more it is joined by shuffle.
    """
    docs = docs.drop(*RESULTS)
    docs = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")  # no name of another column is seen below
    small = docs.select("source").distinct().limit(broadcast_sources + 1).count() <= broadcast_sources
    hint = F.broadcast if small else (lambda x: x)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = docs.withColumn("size", n_words(F.col("text"))).withColumn("_key", key).withColumn("_block", F.pmod(F.shiftrightunsigned("_key", 20), F.lit(blocks)))
    sums = sized.groupBy("source", "_block").agg(F.sum("size").alias("block_size"), F.count("*").alias("n_docs"))
    sums = stored(sums)
    goal = targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most_times).withColumnRenamed("source", "g_source")
    order = Window.partitionBy("source").orderBy("_block")
    plan = sums.join(F.broadcast(goal) if small else goal, same("source", "g_source")).drop("g_source")
    plan = plan.withColumn("until", F.sum("block_size").over(order)).withColumn("rank", F.row_number().over(order).cast("long")).withColumn("n_blocks", F.count("*").over(Window.partitionBy("source")))
    plan = plan.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.round(F.col("target") - F.col("base") * F.col("source_size") - (F.col("until") - F.col("block_size"))))
    # whole: one more draw of the block; cut: a draw of single documents of it, up to `left` words
    plan = plan.withColumn("whole", (F.col("left") > 0) & (F.col("left") >= F.col("block_size"))).withColumn("cut", ~F.col("whole") & (F.col("left") > 0))
    plan = plan.withColumn("draws", F.col("base") + (F.col("whole") | F.col("cut")).cast("long"))
    shards = split_quotas(plan.groupBy("source").agg(F.sum("draws").alias("quota")), shard_levels, seed)
    at = shards.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "first"))).alias("runs")).withColumnRenamed("source", "a_source")
    plan = plan.join(F.broadcast(at) if small else at, same("source", "a_source")).drop("a_source")
    # round r of block rank b is draw (r - 1) * n_blocks + b - 1 of its source; its shard is the last whose run has begun
    number = lambda r: (r - 1) * F.col("n_blocks") + F.col("rank") - 1
    rounds = F.when(F.col("draws") > 0, F.sequence(F.lit(1).cast("long"), F.col("draws"))).otherwise(F.array().cast("array<bigint>"))
    of = F.transform(rounds, lambda r: F.array_max(F.transform(F.filter("runs", lambda x: x["first"] <= number(r)), lambda x: x["shard"])))
    plan = stored(plan.select(F.col("source").alias("p_source"), F.col("_block").alias("p_block"), "source_size", "target", "base", "whole", "cut", "left", of.alias("plan_shards")))
    here = same("source", "p_source") & (F.col("_block") == F.col("p_block"))
    cut = plan.where("cut").select("p_source", "p_block", "left")
    # the cut block gives a prefix of its documents that fits; then the untaken document nearest to the gap may fill it
    narrow = sized.select("source", "_block", "_key", "doc_id", "size")
    run = Window.partitionBy("p_source", "p_block").orderBy("_key", "doc_id")
    edge = narrow.join(hint(cut), here).withColumn("cut_until", F.sum("size").over(run)).where("cut_until <= left")
    edge = edge.groupBy("p_source").agg(F.max(F.struct("_key", "doc_id")).alias("last_taken"), F.max("cut_until").alias("filled")).withColumnRenamed("p_source", "e_source")
    ends = cut.join(edge, same("p_source", "e_source"), "left").select(F.col("p_source").alias("c_source"), F.col("p_block").alias("cut_block"), "last_taken", (F.col("left") - F.coalesce("filled", F.lit(0))).alias("gap"))
    ends = stored(ends)
    mark = F.struct("_key", "doc_id")
    taken = F.coalesce(mark <= F.col("last_taken"), F.lit(False))
    open_ = (F.col("_block") > F.col("cut_block")) | ((F.col("_block") == F.col("cut_block")) & ~taken)
    off = F.abs(F.col("size") - F.col("gap"))
    fill = narrow.join(hint(ends), same("source", "c_source")).where(open_ & (F.col("size") > 0) & (off < F.col("gap")))
    fill = fill.groupBy("c_source").agg(F.min_by(mark, F.struct(off, "_key", "doc_id")).alias("filler")).withColumnRenamed("c_source", "f_source")
    ends = ends.join(fill, same("c_source", "f_source"), "left").drop("f_source")
    cut_shard = plan.where("cut").select(F.col("p_source").alias("k_source"), F.element_at("plan_shards", -1).alias("cut_shard"))
    ends = ends.join(cut_shard, same("c_source", "k_source"), "left").drop("k_source")
    joined = sized.join(hint(plan), here).join(hint(ends), same("source", "c_source"), "left")
    inside = F.col("cut") & taken
    filler = F.coalesce(mark == F.col("filler"), F.lit(False))
    copies = F.col("base") + (F.col("whole") | inside | filler).cast("long")
    drawn = F.slice("plan_shards", F.lit(1), F.when(filler, F.col("base")).otherwise(F.col("copies")).cast("int"))
    joined = joined.withColumn("copies", copies).withColumn("shards", F.when(filler, F.concat(drawn, F.array("cut_shard"))).otherwise(drawn))
    orders = F.transform("shards", lambda shard, i: F.xxhash64(F.lit(seed + 1), "_key", shard, i))
    return joined.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards", orders.alias("orders"))


def draws(mixed: DataFrame) -> DataFrame:
    """One row per draw of a mix, with its shard and its place (order) there; every shard is shuffled locally.

    A shard is dealt by ranges of its places, which are hashes, so a task has a part of a shard however large it is.
    """
    one = F.explode(F.arrays_zip("shards", "orders")).alias("draw")
    rows = mixed.select(*[F.col(f"`{c}`") for c in mixed.columns if c not in ("shards", "orders", "shard", "order")], one)
    rows = rows.select("*", F.col("draw.shards").alias("shard"), F.col("draw.orders").alias("order")).drop("draw")
    return rows.repartitionByRange("shard", "order").sortWithinPartitions("shard", "order")


def write_shards(mixed: DataFrame, path: str) -> None:
    """The draws as Parquet files by shard, in shuffled order."""
    draws(mixed).write.partitionBy("shard").parquet(path)
