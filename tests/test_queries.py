"""Every registered query of the version log against its SQL, and the total order helpers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators.ordering import global_row_number
from tidemark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def tidy(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tidy(r[c] for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted((tidy(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)


def test_global_row_number_with_ties_and_one_hot_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"), "id")
    for buckets in (1, 5, 40):
        found = global_row_number(rows, ["k", "id"], "n", buckets=buckets).orderBy("n").collect()
        assert [r["n"] for r in found] == list(range(1, 2001))
        assert [(r["k"], r["id"]) for r in found] == sorted((r["k"], r["id"]) for r in found)


def test_percentiles(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3)], "x long")
    assert {r["permille"]: r["x"] for r in stats.nearest_rank(df, ["x"], "x", [0, 500, 999, 1000]).collect()} == {0: 1, 500: 3, 999: 4, 1000: 5}
    assert stats.nearest_rank(df.where("x > 9"), ["x"], "x", [500]).count() == 0
