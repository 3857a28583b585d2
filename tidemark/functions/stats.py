"""Statistics: amplification, levels, percentiles and log checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import global_row_number
from ..operators.views import DEFAULT, Names


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def write_amplification(log: DataFrame, user_bytes: Column, flushed: Column, compacted: Column) -> DataFrame:
    """One row: bytes written by flush and compaction for each byte that users wrote, and the share of flushes alone."""
    found = log.agg(F.sum(user_bytes).alias("u"), F.sum(flushed).alias("f"), F.sum(compacted).alias("c"))
    return found.select(F.round(ratio(F.col("f") + F.col("c"), F.col("u")), 6).alias("write_amp"), F.round(ratio(F.col("f"), F.col("u")), 6).alias("write_amp_flush"))


def space_amplification(files: DataFrame, user_bytes: DataFrame) -> DataFrame:
    """One row: bytes that runs hold for each byte of live user data. user_bytes: one row, one column."""
    held = files.agg(F.sum("size").alias("held"))
    return held.crossJoin(F.broadcast(user_bytes.toDF("user"))).select(F.round(ratio(F.col("held"), F.col("user")), 6).alias("space_amp"))  # one row each


def nearest_rank(df: DataFrame, order: list[str], value: str, permille: list[int]) -> DataFrame:
    """(permille, value): the value at position floor(p * (n - 1) / 1000) in the order of the columns ``order``, from 0."""
    ranked = global_row_number(df, list(order), "__rank", base=-1)
    n = ranked.count()
    if not n:
        return df.select(F.lit(None).cast("int").alias("permille"), value).where("false")
    wanted = F.array(*[F.struct(F.lit(p).alias("permille"), F.lit(p * (n - 1) // 1000).cast("long").alias("at")) for p in permille])
    hit = ranked.withColumn("__w", F.explode(F.filter(wanted, lambda w: w["at"] == F.col("__rank"))))
    return hit.select(F.col("__w.permille").alias("permille"), value)


def contiguity(log: DataFrame, names: Names = DEFAULT) -> DataFrame:
    """One row about a log's sequences: the first, the last, how many, and whether they run from 1 without gaps or repeats."""
    found = log.agg(F.min(names.seq).alias("first_seq"), F.max(names.seq).alias("last_seq"), F.count(F.lit(1)).alias("n"), F.countDistinct(names.seq).alias("n_distinct"))
    return found.withColumn("contiguous", F.coalesce((F.col("first_seq") == 1) & (F.col("last_seq") == F.col("n")) & (F.col("n") == F.col("n_distinct")), F.lit(False)))


def stat_lines(stats: DataFrame, kind: str) -> DataFrame:
    """Each row as one line: the kind, then NAME=value for every column, in order."""
    fields = [F.concat(F.lit(f"{c.upper()}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in stats.columns]
    return stats.select(F.concat_ws(" ", F.lit(kind), *fields).alias("line"))
