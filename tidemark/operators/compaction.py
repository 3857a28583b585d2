"""Garbage rules of compaction: which versions no snapshot can see any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .views import DEFAULT, Names


def should_drop(kind: Column, seq: Column, newer: Column, smallest_snapshot: int, base: Column) -> Column:
    """May a version go? ``newer`` is the next newer sequence of its key, null for its newest version.

    It goes if a newer version is visible at the smallest snapshot already, or if it is a delete that every snapshot sees and
    nothing deeper holds the key.
    """
    hidden = F.coalesce(newer <= smallest_snapshot, F.lit(False))
    return hidden | ((kind == 0) & (seq <= smallest_snapshot) & base)


def judged(log: DataFrame, smallest_snapshot: int, base: Column | str = "base", names: Names = DEFAULT) -> DataFrame:
    """The log, each version once, with ``drop``. One window over each key's versions, from new to old."""
    base = F.col(base) if isinstance(base, str) else base
    once = log.dropDuplicates([names.key, names.seq, names.kind])
    order = Window.partitionBy(names.key).orderBy(F.desc(names.seq), F.desc(names.kind))
    marked = once.withColumn("__newer", F.lag(names.seq).over(order))
    return marked.withColumn("drop", should_drop(F.col(names.kind), F.col(names.seq), F.col("__newer"), smallest_snapshot, base)).drop("__newer")


def compact(log: DataFrame, smallest_snapshot: int, base: Column | str = "base", names: Names = DEFAULT) -> DataFrame:
    """The versions that stay. Every view at the smallest snapshot or later is what it was."""
    return judged(log, smallest_snapshot, base, names).where("not drop").drop("drop")


def dropped_counts(log: DataFrame, smallest_snapshot: int, base: Column | str = "base", names: Names = DEFAULT) -> DataFrame:
    """One row: old versions and deletes that go, by the kind of the version."""
    found = judged(log, smallest_snapshot, base, names).where("drop")
    return found.agg(F.count_if(F.col(names.kind) == 1).alias("dropped_old"), F.count_if(F.col(names.kind) == 0).alias("dropped_tombstones"))


def runs(log: DataFrame, rows_per_run: int, names: Names = DEFAULT) -> DataFrame:
    """The log with run: flushes of ``rows_per_run`` consecutive sequences each."""
    return log.withColumn("run", F.floor((F.col(names.seq) - 1) / rows_per_run).cast("long"))


def file_metadata(log: DataFrame, run: str = "run", bytes_per_row: int = 100, names: Names = DEFAULT) -> DataFrame:
    """One row for each run: number, n_entries, file_size, max_sequence, and its first and last version in the store's order.

    max_sequence is the largest of the run; the last version in the store's order has the smallest sequence of the largest key.
    """
    place = F.struct(F.col(names.key).alias("k"), (-F.col(names.seq)).alias("s"), (-F.col(names.kind)).alias("t"))
    found = log.groupBy(F.col(run).alias("number")).agg(F.count(F.lit(1)).alias("n_entries"), F.max(names.seq).alias("max_sequence"), F.min(place).alias("a"), F.max(place).alias("b"))
    return found.select(
        "number", "n_entries", (F.col("n_entries") * bytes_per_row).alias("file_size"), "max_sequence", F.col("a.k").alias("smallest_k"), (-F.col("a.s")).alias("smallest_seq"), (-F.col("a.t")).alias("smallest_t"),
        F.col("b.k").alias("largest_k"), (-F.col("b.s")).alias("largest_seq"), (-F.col("b.t")).alias("largest_t"),
    )
