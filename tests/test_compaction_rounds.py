"""A round of compaction takes all that makes a level due, so rounds grow with the levels and not with the files."""

import random

import pytest

from tidemark.operators import levels
from tidemark.options import Options
from tidemark.sources.store import Store


def files(spark, rows):
    return spark.createDataFrame(rows, "level int, number long, lo long, hi long, size long")


def picked(spark, rows, level, options):
    return sorted(r["number"] for r in levels.pick_seeds(files(spark, rows), level, options).collect())


def test_seeds_go_on_until_the_level_is_not_due(spark):
    rows = [(1, n, 10 * n, 10 * n + 5, 100) for n in range(1, 9)]
    assert picked(spark, rows, 1, Options(level_base_bytes=800)) == [1]
    assert picked(spark, rows, 1, Options(level_base_bytes=301)) == [1, 2, 3, 4, 5]
    assert picked(spark, rows, 1, Options(level_base_bytes=300)) == [1, 2, 3, 4, 5, 6]
    assert picked(spark, rows, 1, Options(level_base_bytes=1)) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert picked(spark, rows, 1, Options(level_base_bytes=10_000)) == [1]  # not due: the seed
    assert picked(spark, rows, 2, Options()) == []


def test_seeds_have_no_gap_in_either_direction(spark):
    rows = [(1, n, 10 * n, 10 * n + 5, 100) for n in range(1, 9)] + [(2, 20 + n, 10 * n, 10 * n + 5, 1 if n == 6 else 50) for n in range(1, 9)]
    assert picked(spark, rows, 1, Options(level_base_bytes=601, pick="min_overlap")) == [6, 7]
    assert picked(spark, rows, 1, Options(level_base_bytes=301, pick="min_overlap")) == [4, 5, 6, 7, 8]


def test_seeds_of_level_0_bring_their_closures(spark):
    rows = [(0, 5, 0, 4, 9), (0, 6, 4, 8, 9), (0, 3, 20, 25, 9), (0, 4, 24, 30, 9), (0, 7, 40, 41, 9), (1, 9, 26, 44, 9)]
    assert picked(spark, rows, 0, Options(level0_trigger=4)) == [3, 4]
    assert picked(spark, rows, 0, Options(level0_trigger=3)) == [3, 4, 7]
    assert picked(spark, rows, 0, Options(level0_trigger=1)) == [3, 4, 5, 6, 7]
    seeds = levels.pick_seeds(files(spark, rows), 0, Options(level0_trigger=3))
    assert sorted(r["number"] for r in levels.inputs(files(spark, rows), 0, seeds).collect()) == [3, 4, 7, 9]


@pytest.mark.parametrize("pick", ["round_robin", "min_overlap"])
def test_a_large_store_is_stable_after_a_round_for_each_level(spark, tmp_path, pick):
    random.seed(3)
    store = Store.open(spark, str(tmp_path / "db"), spark.createDataFrame([], "k long, v string").schema, Options(level0_trigger=2, level_base_bytes=30_000, level_multiplier=4, max_file_size=10_000, pick=pick, bloom_bits=0))
    want, then, snapshot = {}, {}, None
    for c in range(3):
        rows = [(i, int(random.random() > 0.2), random.randrange(1500), f"{c}-{i}-{random.random()}" * 4) for i in range(1200)]
        store.write_frame(spark.createDataFrame(rows, "ord long, t int, k long, v string"), ["ord"])
        for _, t, k, v in rows:
            want.pop(k, None)
            if t:
                want[k] = v
        if snapshot is None:
            snapshot, then = store.snapshot(), dict(want)
    assert store.compact_until_stable() <= 4  # 12 when a round took one file
    assert len(store.manifest.runs) > 12 and max(r.level for r in store.manifest.runs) >= 2
    assert levels.pick_level(store.files(), store.options).first()[0] == -1 and levels.violations(store.files()).count() == 0
    assert {r["k"]: r["v"] for r in store.scan().collect()} == want
    assert {r["k"]: r["v"] for r in store.scan(snapshot=snapshot).collect()} == then
