"""Reads of a version log: a DataFrame of (key, sequence, kind, payload), where kind 1 is a put and 0 a delete.

A key's visible version at snapshot S is its version with the largest sequence of S or less; a put comes before a delete
of the same sequence. The key is visible if that version is a put. Versions with equal key, sequence and kind are copies
of one another (replayed commits) and count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import global_row_number, neighbours as _neighbours, union


@dataclass(frozen=True)
class Names:
    """Column names of a version log."""

    key: str = "k"
    seq: str = "seq"
    kind: str = "t"


DEFAULT = Names()


def newest(log: DataFrame, as_of: int | Column | None = None, names: Names = DEFAULT) -> DataFrame:
    """Each key's newest version at the snapshot, deletes included.

    The snapshot filter stands before the ranking and reaches the scan; ranking to one row is cut down
    map-side (a partial group limit), so a hot key is no hot task.
    """
    if as_of is not None:
        log = log.where(F.col(names.seq) <= as_of)
    order = Window.partitionBy(names.key).orderBy(F.desc(names.seq), F.desc(names.kind))
    return log.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def latest(log: DataFrame, as_of: int | Column | None = None, names: Names = DEFAULT) -> DataFrame:
    """All live rows at the snapshot: the newest versions that are puts. The delete filter comes after the ranking."""
    return newest(log, as_of, names).where(F.col(names.kind) == 1)


def get(log: DataFrame, key, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """The live version of one key: one row, or none. The key filter reaches the scan."""
    return latest(log.where(F.col(names.key) == F.lit(key)), as_of, names)


def multi_get(log: DataFrame, probes: DataFrame, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """A row for each distinct key of ``probes`` (its only column): the newest version with status OK, Deleted or NotFound.

    The log is cut to the probed keys (semi-join) before it is ranked.
    """
    wanted = probes.select(F.col(probes.columns[0]).alias(names.key)).distinct()
    found = newest(log.join(wanted, names.key, "left_semi"), as_of, names)
    status = F.when(F.col(names.kind).isNull(), "NotFound").when(F.col(names.kind) == 0, "Deleted").otherwise("OK")
    return wanted.join(found, names.key, "left").withColumn("status", status)


def range_scan(log: DataFrame, low=None, high=None, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """Live rows with low <= key < high; None is open."""
    k = F.col(names.key)
    if low is not None:
        log = log.where(k >= F.lit(low))
    if high is not None:
        log = log.where(k < F.lit(high))
    return latest(log, as_of, names)


def prefix_scan(log: DataFrame, prefix: str | bytes, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """Live rows whose key starts with ``prefix``, as a range of keys, so that statistics of the files prune."""
    raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
    k = F.col(names.key)
    log = log.where(k.startswith(F.lit(prefix))) if raw else log
    if raw:
        log = log.where(k >= F.lit(prefix))
    return latest(log, as_of, names)


def reverse_scan(log: DataFrame, limit: int, below=None, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """The ``limit`` live rows with the largest keys (below ``below``), from the largest down."""
    return range_scan(log, None, below, as_of, names).orderBy(F.desc(names.key)).limit(limit)


def first_last(log: DataFrame, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """One row: the smallest and the largest live key (nulls if there is none)."""
    return latest(log, as_of, names).agg(F.min(names.key).alias("first_key"), F.max(names.key).alias("last_key"))


def seek(log: DataFrame, target, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """The live row with the smallest key of ``target`` or more: one row, or none."""
    return range_scan(log, target, None, as_of, names).orderBy(names.key).limit(1)


def next_previous(log: DataFrame, as_of: int | None = None, names: Names = DEFAULT) -> DataFrame:
    """All live keys, each with the live key before and after it."""
    return _neighbours(latest(log, as_of, names).select(names.key), names.key, "prev_key", "next_key")


def internal_order(log: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """All versions with pos, their place in the store's order: key up, then sequence and kind down."""
    return global_row_number(log, [F.col(names.key), -F.col(names.seq), -F.col(names.kind)], "pos")


def history(log: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """For each key its number of versions and deletes, and its first and last sequence."""
    return log.groupBy(names.key).agg(
        F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col(names.kind) == 0).alias("n_deletes"), F.min(names.seq).alias("min_seq"), F.max(names.seq).alias("max_seq")
    )


def merge(*logs: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """One log from several (base, overlays, replays): each version once."""
    return union(list(logs)).dropDuplicates([names.key, names.seq, names.kind])


def changes(log: DataFrame, after: int, upto: int, value: str, names: Names = DEFAULT) -> DataFrame:
    """What happened to each key between two snapshots: (key, change, old, new), change being insert, update or delete.

    A key that was rewritten with the same value is an update if its sequence changed. Both views are partitioned by key, so
    their join moves nothing again.
    """
    old = latest(log, after, names).select(F.col(names.key), F.col(names.seq).alias("old_seq"), F.col(value).alias("old"))
    new = latest(log, upto, names).select(F.col(names.key).alias("__k"), F.col(names.seq).alias("new_seq"), F.col(value).alias("new"))
    both = old.join(new, F.col(names.key) == F.col("__k"), "full_outer").where(~F.col("old_seq").eqNullSafe(F.col("new_seq")))
    change = F.when(F.col("old_seq").isNull(), "insert").when(F.col("new_seq").isNull(), "delete").otherwise("update")
    return both.select(F.coalesce(names.key, "__k").alias(names.key), change.alias("change"), "old", "new")
