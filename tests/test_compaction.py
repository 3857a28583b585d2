"""Garbage rules, levels and overlap: small exact cases, and invariants on random logs."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compaction, levels, views
from tidemark.options import Options

FILES = "level int, number long, lo string, hi string, size long"
NEVER = None


@pytest.mark.parametrize("kind, seq, newer, smallest, base, drop", [
    (1, 10, 10, 10, False, True), (1, 10, 5, 10, False, True), (0, 10, NEVER, 10, True, True), (0, 10, NEVER, 10, False, False),
    (0, 11, NEVER, 10, True, False), (1, 10, NEVER, 10, True, False), (1, 5, 20, 10, False, False),
])
def test_drop_rule(spark, kind, seq, newer, smallest, base, drop):
    row = spark.createDataFrame([(kind, seq, newer, base)], "t int, seq long, newer long, base boolean")
    assert row.select(compaction.should_drop(F.col("t"), F.col("seq"), F.col("newer"), smallest, F.col("base"))).first()[0] is drop


def files(spark, rows):
    return spark.createDataFrame([(*r, 1000) if len(r) == 4 else r for r in rows], FILES)


def test_level0_is_due_by_count(spark):
    three = [(0, n, "a", "b") for n in range(3)]
    assert levels.pick_level(files(spark, three), Options()).first()[0] == -1
    assert levels.pick_level(files(spark, [*three, (0, 3, "a", "b")]), Options()).first()[0] == 0


def test_deeper_levels_are_due_by_bytes_and_ties_go_up(spark):
    o = Options(level_base_bytes=1000, level0_trigger=1)
    assert levels.pick_level(files(spark, [(1, 1, "a", "b", 999)]), o).first()[0] == -1
    assert levels.pick_level(files(spark, [(1, 1, "a", "b", 1000)]), o).first()[0] == 1
    assert levels.pick_level(files(spark, [(0, 2, "a", "b"), (1, 1, "a", "b", 2000)]), o).first()[0] == 1
    assert levels.pick_level(files(spark, [(0, 2, "a", "b"), (1, 1, "a", "b", 1000)]), o).first()[0] == 0
    assert levels.pick_level(files(spark, [(6, 1, "a", "b", 10**12)]), o).first()[0] == -1


def test_capacity_grows_and_saturates():
    o = Options(level_base_bytes=2**50, level_multiplier=1000)
    assert [levels.max_bytes(n, o) for n in (0, 1, 6)] == [0, 2**50, 2**63 - 1]


def test_seeds(spark):
    rows = [(0, 5, "a", "b"), (0, 3, "c", "d"), (0, 1, "e", "f"), (1, 4, "a", "b"), (1, 9, "m", "n")]
    assert levels.pick_seed(files(spark, rows), 0).first()[0] == 1
    assert levels.pick_seed(files(spark, rows), 1).first()[0] == 4
    tie = [(0, 5, "a", "b"), (0, 3, "m", "n"), (1, 4, "a", "b"), (1, 9, "m", "n")]
    assert levels.pick_seed(files(spark, tie), 0, "min_overlap").first()[0] == 3
    assert levels.pick_seed(files(spark, tie[:3]), 0, "min_overlap").first()[0] == 3


def test_level0_closure_is_transitive(spark):
    rows = [(0, 3, "a", "b"), (0, 2, "c", "d"), (0, 1, "b", "c"), (0, 7, "x", "y"), (1, 8, "d", "e"), (1, 9, "f", "g")]
    assert sorted(r["number"] for r in levels.inputs(files(spark, rows), 0, 3).collect()) == [1, 2, 3, 8]


def test_closure_equals_the_fixpoint_on_random_layouts(spark):
    random.seed(5)
    rows = []
    for layout in range(12):
        for n in range(10):
            a = random.randrange(60)
            rows.append((layout, layout * 100 + n, a, a + random.randrange(8), 1))
    found = levels.closures(spark.createDataFrame(rows, "level int, number long, lo long, hi long, size long")).collect()
    part = {r["number"]: (r["level"], r["closure"]) for r in found}
    for layout, number, lo, hi, _ in rows:
        grown = {number}
        while True:
            lo, hi = min(r[2] for r in rows if r[1] in grown), max(r[3] for r in rows if r[1] in grown)
            more = {r[1] for r in rows if r[0] == layout and r[2] <= hi and lo <= r[3]}
            if more == grown:
                break
            grown = more
        assert {n for n, p in part.items() if p == part[number]} == grown


def test_base_level_looks_two_levels_down(spark):
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    near, deep = files(spark, [(2, 1, "a", "b")]), files(spark, [(3, 1, "a", "b")])
    assert {r["k"]: r["base"] for r in levels.base_level(keys, "k", near, 1).collect()} == {"a": True, "z": True}
    assert {r["k"]: r["base"] for r in levels.base_level(keys, "k", deep, 1).collect()} == {"a": False, "z": True}


def test_violations(spark):
    rows = [(0, 1, "a", "z"), (0, 2, "a", "z"), (1, 3, "a", "c"), (1, 4, "c", "d"), (2, 4, "x", "b", 0)]
    assert sorted((r["number"], r["rule"]) for r in levels.violations(files(spark, rows)).collect()) == [(4, "number"), (4, "number"), (4, "overlap"), (4, "range"), (4, "size")]


def test_edits_delete_first(spark):
    rows = files(spark, [(0, 1, "a", "b"), (0, 2, "c", "d")])
    moved = rows.where("number = 1")
    assert sorted((r["level"], r["number"]) for r in levels.apply_edit(rows, moved, moved.withColumn("level", F.lit(1))).collect()) == [(0, 2), (1, 1)]


def test_compaction_changes_no_view(spark):
    random.seed(3)
    log = spark.createDataFrame([(random.randrange(12), s, int(random.random() < 0.7), s) for s in range(1, 300)], "k long, seq long, t int, v long")
    for smallest in (0, 100, 299):
        kept = compaction.compact(log, smallest, F.lit(True))
        for at in {smallest, 200, 299}:
            if at >= smallest:
                assert sorted(map(tuple, views.latest(log, at).collect())) == sorted(map(tuple, views.latest(kept, at).collect()))
    assert compaction.compact(log, 299, F.lit(True)).count() == views.latest(log).count()


def test_counts_are_by_kind(spark):
    log = spark.createDataFrame([("a", 3, 1), ("a", 2, 0), ("a", 1, 1), ("b", 4, 0)], "k string, seq long, t int")
    assert tuple(compaction.dropped_counts(log, 4, F.lit(True)).first()) == (1, 2)


def test_metadata_of_a_run(spark):
    log = spark.createDataFrame([("a", 3, 1, 0), ("a", 9, 1, 0), ("b", 2, 0, 0), ("b", 1, 1, 0)], "k string, seq long, t int, run int")
    r = compaction.file_metadata(log).first()
    assert (r.smallest_k, r.smallest_seq, r.largest_k, r.largest_seq, r.largest_t, r.max_sequence, r.n_entries) == ("a", 9, "b", 1, 1, 9, 4)
