"""Levels of runs: capacity, choice of what to compact, overlap, layout checks and edits.

Files are a DataFrame of (level, number, lo, hi, size): a run's level, its number, the smallest and largest key and its
bytes. Level 0 runs may overlap; those of a deeper level must not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.intervals import Intervals
from ..options import LEVELS, Options

#: Capacities stop growing here.
LARGEST = 2**63 - 1


def max_bytes(level: int, options: Options) -> int:
    """A level's capacity: 0 for level 0, the base for level 1, and ``level_multiplier`` times as much for each further one."""
    return 0 if level == 0 else min(options.level_base_bytes * options.level_multiplier ** (level - 1), LARGEST)


def capacities(spark: SparkSession, options: Options) -> DataFrame:
    return spark.createDataFrame([(n, max_bytes(n, options)) for n in range(LEVELS)], "level int, capacity long")


def scores(files: DataFrame, options: Options) -> DataFrame:
    """(level, files, bytes, score) of all levels: runs against the trigger for level 0, bytes against capacity for others."""
    held = files.groupBy(F.col("level").cast("int").alias("l")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))
    every = capacities(files.sparkSession, options).join(F.broadcast(held), F.col("level") == F.col("l"), "left")
    count, size = F.coalesce("files", F.lit(0)).cast("long"), F.coalesce("bytes", F.lit(0)).cast("long")
    score = F.when(F.col("level") == 0, count / F.lit(float(options.level0_trigger))).otherwise(size / F.greatest("capacity", F.lit(1)).cast("double"))
    return every.select("level", count.alias("files"), size.alias("bytes"), score.alias("score"))


def pick_level(files: DataFrame, options: Options) -> DataFrame:
    """One row: the level that is due most (score of 1 or more; the smaller one of a tie), or -1. The last level has nowhere to go."""
    due = scores(files, options).where((F.col("score") >= 1) & (F.col("level") < LEVELS - 1))
    return due.agg(F.coalesce(F.max_by(F.col("level"), F.struct("score", -F.col("level"))), F.lit(-1)).alias("level"))


def overlaps(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """For each file of ``upper`` the bytes of files in ``lower`` that its key range touches: (number, overlap)."""
    return upper.select("number", Intervals.of(lower, "size").column("lo", "hi").alias("overlap"))


def pick_seed(files: DataFrame, level: int, strategy: str = "round_robin") -> DataFrame:
    """One row (number): the file that compaction of the level starts from; no row for an empty level.

    round_robin: the smallest number in level 0, the smallest key elsewhere. min_overlap: the fewest bytes below; ties to the smallest number.
    """
    own = files.where(F.col("level") == level)
    if strategy == "min_overlap":
        return overlaps(own, files.where(F.col("level") == level + 1)).orderBy("overlap", "number").limit(1).select("number")
    return own.orderBy(*(["number"] if level == 0 else ["lo", "number"])).limit(1).select("number")


def closures(files: DataFrame) -> DataFrame:
    """``files`` with closure: files have the same one if a chain of overlapping closed key ranges joins them.

    Gaps and islands in one pass over the ranges by their start; the manifest of one level is what is ordered, not its data.
    """
    earlier = Window.partitionBy("level").orderBy("lo", "hi", "number")
    reach = F.max("hi").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    opened = files.withColumn("__reach", reach).withColumn("__open", (F.col("__reach").isNull() | (F.col("lo") > F.col("__reach"))).cast("int"))
    return opened.withColumn("closure", F.sum("__open").over(earlier.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__reach", "__open")


def pick_seeds(files: DataFrame, level: int, options: Options) -> DataFrame:
    """Rows (number): the files that one round of compaction takes from the level, so that it is due no longer; the seed of :meth:`pick_seed` at least.

    After the seed come the files that follow by key and then those before it, whole closures each. So the ranges taken leave none out between them,
    and a level that is far above its capacity needs one round, not one for each of its files.
    """
    seed = pick_seed(files, level, options.pick).withColumn("__seed", F.lit(True))
    own = closures(files.where(F.col("level") == level)).join(F.broadcast(seed), "number", "left")
    held, most = (F.count(F.lit(1)), options.level0_trigger) if level == 0 else (F.sum("size"), max_bytes(level, options))
    groups = own.groupBy("level", "closure").agg(held.alias("__held"), F.max("__seed").alias("__seed"))
    groups = groups.withColumn("__from", F.max(F.when(F.col("__seed"), F.col("closure"))).over(Window.partitionBy("level")))
    onward = Window.partitionBy("level").orderBy(F.col("closure") < F.col("__from"), F.abs(F.col("closure") - F.col("__from")))
    left = F.sum("__held").over(onward.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    taken = groups.withColumn("__left", left).where((F.col("__left") >= most) | F.col("__seed")).select("closure")
    return own.join(F.broadcast(taken), "closure", "left_semi").select("number")


def inputs(files: DataFrame, level: int, seeds: DataFrame | int) -> DataFrame:
    """The files of ``level`` and the one below that a compaction from the files ``seeds`` (number), or from one, takes.

    In level 0 a seed brings its whole closure. Of the level below, all files that touch the key range of all those.
    """
    own = files.where(F.col("level") == level)
    own = closures(own) if level == 0 else own.withColumn("closure", F.col("number"))
    first = own.where(F.col("number") == seeds) if isinstance(seeds, int) else own.join(F.broadcast(seeds), "number", "left_semi")
    upper = own.join(F.broadcast(first.select("closure")), "closure", "left_semi")
    span = upper.agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi"))
    lower = files.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("lo") <= F.col("__hi")) & (F.col("__lo") <= F.col("hi")), "left_semi")
    return upper.select(files.columns).union(lower.select(files.columns))


def base_level(keys: DataFrame, key: str, files: DataFrame, level: int) -> DataFrame:
    """``keys`` with base: no file two or more levels below ``level`` covers the key. Narrow: each key is looked up in the sorted ranges."""
    deep = Intervals.of(files.where(F.col("level") >= level + 2))
    return keys.withColumn("base", deep.column(key) == 0)


def violations(files: DataFrame) -> DataFrame:
    """Files that break the layout: (level, number, rule). Below level 0 neighbours must be disjoint; numbers are unique; a range isn't inverted; sizes are positive."""
    order = Window.partitionBy("level").orderBy("lo", "hi", "number")
    marked = files.withColumn("__before", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__same", F.count(F.lit(1)).over(Window.partitionBy("number")))
    rules = F.array(
        F.when((F.col("level") > 0) & (F.col("__before") >= F.col("lo")), "overlap"), F.when(F.col("__same") > 1, "number"),
        F.when(F.col("lo") > F.col("hi"), "range"), F.when(F.col("size") <= 0, "size"),
    )
    return marked.select("level", "number", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def apply_edit(files: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The files without ``removed`` (level, number), then with ``added``; deletes come first, so a file may move down a level."""
    return files.join(removed.select("level", "number"), ["level", "number"], "left_anti").unionByName(added)


def unreferenced(listing: DataFrame, live: DataFrame, on: str = "number") -> DataFrame:
    """Files of ``listing`` that no live version names: candidates for deletion, and orphans of writers that died."""
    return listing.join(live.select(on).distinct(), on, "left_anti")


def covering(probes: DataFrame, key: str, files: DataFrame) -> DataFrame:
    """For each probe key the number of files whose range covers it, and of those in level 0: what a read has to look at
    after range pruning."""
    return probes.select(key, Intervals.of(files).column(key).alias("files"), Intervals.of(files.where(F.col("level") == 0)).column(key).alias("level0_files"))
