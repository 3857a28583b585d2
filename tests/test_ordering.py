"""Buckets of the total order are looked up by halving, not by a list of all bounds for each row."""

from pyspark.sql import functions as F

from tidemark.operators import ordering


def test_buckets_are_looked_up_by_halving(spark):
    rows = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("x"))
    for buckets in (2, 3, 8, 37, 64):
        keyed = ordering._buckets(rows, [F.col("x"), F.col("k")], buckets)
        found = keyed.select("x", "k", "__b").collect()
        found.sort(key=lambda r: (r["x"] is not None, r["x"] or 0, r["k"]))
        placed = [r["__b"] for r in found]
        assert placed == sorted(placed) and set(placed) == set(range(buckets))
        assert "lambda" not in keyed._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_follow_an_order_of_expressions(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    found = ordering.global_row_number(rows, [F.col("k"), -F.col("id")], "n", buckets=13).collect()
    want = sorted(((r["k"], -r["id"]) for r in found))
    assert [(r["k"], -r["id"]) for r in sorted(found, key=lambda r: r["n"])] == want and sorted(r["n"] for r in found) == list(range(1, 501))
