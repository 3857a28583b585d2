"""Total order without a single task: global row numbers and neighbours over range buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Rows of the sample that bucket boundaries are taken from; any boundaries give right results, these give even ones.
SAMPLE = 2048


def _buckets(df: DataFrame, order: list[Column], buckets: int) -> DataFrame:
    """Adds __o (the order key) and __b: the range bucket, by boundaries from a bounded sample."""
    keyed = df.withColumn("__o", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    drawn = keyed.select("__o").orderBy(F.xxhash64("__o"), "__o").limit(SAMPLE).orderBy("__o").collect()
    step = max(1, len(drawn) // buckets)
    bounds = [r["__o"] for r in drawn[step::step]][: buckets - 1]
    if not bounds:
        return keyed.withColumn("__b", F.lit(0))
    # how many bounds are at most the key, by halving: a column for each step, so that none is computed twice
    table = df.sparkSession.createDataFrame([(bounds,)], StructType([StructField("__bounds", ArrayType(keyed.schema["__o"].dataType))]))
    keyed = keyed.crossJoin(F.broadcast(table)).withColumn("__b", F.lit(0))  # one row
    for step in (1 << i for i in reversed(range(len(bounds).bit_length()))):
        keyed = keyed.withColumn("__b", F.col("__b") + F.when(F.get("__bounds", F.col("__b") + (step - 1)) <= F.col("__o"), step).otherwise(0))
    return keyed.drop("__bounds")


def global_row_number(df: DataFrame, order: list[Column | str], name: str, base: int = 0, buckets: int | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... (plus ``base``) in the total order of the columns ``order``, all ascending.

    Rows are numbered within range buckets, each in a task of its own, and shifted by the sizes of earlier buckets (one row
    for each bucket). Ties should be broken by ``order`` itself; nulls come first.
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = _buckets(df, order, n)
    sizes = {r["__b"]: r["n"] for r in keyed.groupBy("__b").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, table = base, []
    for b in range(n):
        table.append(F.lit(shift).cast("long"))
        shift += sizes.get(b, 0)
    number = F.row_number().over(Window.partitionBy("__b").orderBy(*order)).cast("long")
    return keyed.drop("__o").withColumn(name, number + F.get(F.array(*table), F.col("__b"))).drop("__b")


def neighbours(df: DataFrame, key: str, previous: str, following: str, buckets: int | None = None) -> DataFrame:
    """``df`` (one row for each key) with the keys before and after each row's own in the total order; null at the ends.

    Within a bucket by lag and lead; across buckets from each bucket's first and last key (one row for each bucket).
    """
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = _buckets(df, [F.col(key)], n)
    kind = df.schema[key].dataType
    ends = sorted((r["__b"], r["lo"], r["hi"]) for r in keyed.groupBy("__b").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect())
    before = {b: ends[i - 1][2] for i, (b, _, _) in enumerate(ends) if i}
    after = {b: ends[i + 1][1] for i, (b, _, _) in enumerate(ends[:-1])}

    def table(values: dict) -> Column:
        return F.get(F.array(*[F.lit(values.get(b)).cast(kind) for b in range(n)]), F.col("__b"))

    w = Window.partitionBy("__b").orderBy("__o")
    return keyed.withColumn(previous, F.coalesce(F.lag(key).over(w), table(before))).withColumn(following, F.coalesce(F.lead(key).over(w), table(after))).drop("__o", "__b")


def union(frames: list[DataFrame]) -> DataFrame:
    """All frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
