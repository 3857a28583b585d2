"""Views of a version log against small exact cases and a dictionary."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import views

LOG = "k string, seq long, t int, v string"
SEEN = [("a", 10, 1, "a10"), ("a", 5, 1, "a5"), ("b", 9, 1, "b9"), ("b", 4, 0, None), ("b", 2, 1, "b2"), ("c", 6, 1, "c6")]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(SEEN, LOG)


def rows(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


@pytest.mark.parametrize("at, want", [(8, [("a", "a5"), ("c", "c6")]), (3, [("b", "b2")]), (10, [("a", "a10"), ("b", "b9"), ("c", "c6")]), (0, [])])
def test_snapshots(log, at, want):
    assert rows(views.latest(log, at)) == want


def test_seek_skips_deleted(log):
    assert rows(views.seek(log, "b", 8)) == [("c", "c6")]
    assert rows(views.seek(log, "d", 8)) == []
    assert [r["k"] for r in views.reverse_scan(log, 5, as_of=8).collect()] == ["c", "a"]


def test_multi_get_says_why(spark, log):
    probes = spark.createDataFrame([("a",), ("b",), ("z",), ("a",)], "p string")
    assert sorted((r["k"], r["status"]) for r in views.multi_get(log, probes, 8).collect()) == [("a", "OK"), ("b", "Deleted"), ("z", "NotFound")]


def test_neighbours(log):
    found = {r["k"]: (r["prev_key"], r["next_key"]) for r in views.next_previous(log).collect()}
    assert found == {"a": (None, "b"), "b": ("a", "c"), "c": ("b", None)}


def test_prefix_and_range(spark):
    log = spark.createDataFrame([("ab", 1, 1, "x"), ("abc", 2, 1, "y"), ("ac", 3, 1, "z"), ("a", 4, 1, "w")], LOG)
    assert rows(views.prefix_scan(log, "ab")) == [("ab", "x"), ("abc", "y")]
    assert rows(views.prefix_scan(log, "")) == [("a", "w"), ("ab", "x"), ("abc", "y"), ("ac", "z")]
    assert rows(views.range_scan(log, "ab", "ac")) == [("ab", "x"), ("abc", "y")]


def test_binary_keys_sort_unsigned_and_prefix_first(spark):
    keys = [b"\xff", b"a", b"a\0", b"\x80", b"\x7f"]
    log = spark.createDataFrame([(k, i + 1, 1, "") for i, k in enumerate(keys)], "k binary, seq long, t int, v string")
    assert [bytes(r["k"]) for r in views.internal_order(log).orderBy("pos").collect()] == sorted(keys)


def test_replayed_versions_count_once(log):
    again = views.merge(log, log.where("seq < 7"))
    assert again.count() == len(SEEN)
    assert rows(views.latest(again)) == rows(views.latest(log))


def test_changes(log):
    found = sorted((r["k"], r["change"], r["old"], r["new"]) for r in views.changes(log, 3, 8, "v").collect())
    assert found == [("a", "insert", None, "a5"), ("b", "delete", "b2", None), ("c", "insert", None, "c6")]


def test_against_a_dictionary(spark):
    random.seed(7)
    versions = [(random.randrange(40), seq, int(random.random() < 0.75), str(seq)) for seq in range(1, 600)]
    log = spark.createDataFrame(versions, "k long, seq long, t int, v string")
    for at in (1, 150, 599):
        want = {}
        for k, seq, t, v in versions:
            if seq <= at:
                want.pop(k, None)
                if t:
                    want[k] = v
        assert {r["k"]: r["v"] for r in views.latest(log, at).collect()} == want


def test_empty(spark):
    log = spark.createDataFrame([], LOG)
    assert views.latest(log).count() == views.next_previous(log).count() == views.internal_order(log).count() == 0
    assert views.first_last(log).first()["first_key"] is None


def test_only_needed_columns_and_the_key_filter_reach_the_scan(spark, tmp_path, log):
    log.write.parquet(str(tmp_path / "log"))
    plan = views.get(spark.read.parquet(str(tmp_path / "log")), "a").select("k")._jdf.queryExecution().toString()
    assert "EqualTo(k,a)" in plan and "ReadSchema: struct<k:string,seq:bigint,t:int>" in plan


def test_hot_keys_are_cut_before_the_shuffle(log):
    assert "WindowGroupLimit" in views.latest(log).select(F.col("k"))._jdf.queryExecution().toString()
