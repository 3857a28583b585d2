"""Embedding near-dedup and exact top-k search against brute force."""

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _common, embedding_dedup, queries, topk

DATA = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, c int"


def planted(seed=0):
    random = np.random.default_rng(seed)
    rows = []
    for group in range(30):
        base = random.standard_normal(16)
        for _ in range(8):
            rows.append((len(rows), (base + 0.08 * random.standard_normal(16)).astype(np.float32).tolist(), group % 3))
    rows += [(len(rows) + i, rows[5][1], 0) for i in range(40)]  # copies
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [None] * 16, 1), (n + 5, [float("inf")] * 16, 1), (n + 6, rows[0][1], None), (n + 7, [1.0] * 8, 1), (n + 8, [1.0] * 8, 1), (n + 9, [3e38] * 16, 2)]
    return rows


def brute(rows, least):
    sound = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = defaultdict(set)
    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in sound}
    for a in sound:
        for b in sound:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least:
                near[a].add(b)
                near[b].add(a)
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in near:
        for b in near[a]:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return near, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("chunk, small", [(1024, 64), (5, 3)])
def test_links_equal_brute_force(spark, monkeypatch, chunk, small):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rows = planted()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    near, part = brute(rows, 0.93)
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(out) == len(rows)
    true, got = sum(map(len, near.values())), sum(r.n_links for r in out.values())
    assert 0.97 * true <= got <= true
    for i in range(len(rows)):
        assert out[i].n_links <= len(near[i]) and out[i].component_id >= part[i] and out[i].kept == (out[i].component_id == i)
    assert sum(out[i].component_id == part[i] for i in out) >= 0.97 * len(rows)
    n = len(rows)
    assert all(out[i].n_links == 0 and out[i].kept for i in range(n - 10, n - 3))


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.near_vectors(none).count() == 0
    assert topk.top_k(none, "vec_id % 20 = 0").count() == 0


def test_recall_at_the_threshold():
    random = np.random.default_rng(3)
    a = random.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = random.standard_normal((4000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    d = embedding_dedup
    keys = [d.bucket_ids(x, d.TABLES, d.FUNCTIONS, d.WIDTH, d.SEED) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() >= 0.95


def test_op1_counts_every_link(spark):
    out = embedding_dedup.op1(spark, "/root/testdata/sf0.01")
    assert out.columns[:4] == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 500


@pytest.mark.parametrize("block, part", [(4096, 512), (16, 5)])
def test_top_k_equals_brute_force(spark, block, part):
    rows = planted(4)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows] + [(None, [1.0], 1, 1, 1)], SCHEMA)
    sound = [(i, np.floor(64 * np.array(v, np.float64))) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    found = defaultdict(list)
    for r in topk.top_k(df, "vec_id % 7 = 0", 12, block=block, part=part).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, x in sound:
        if q % 7 == 0:
            scores = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in sound if i != q)[:12]
            assert found[q] == [(n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scores)]


def test_large_components_are_scored_exactly(spark):
    values = [1.0, 2e6, 3e6, 1.5e6, 2e6 + 1 / 64, 1e12, -1e12, 1e15, 3e38, 2.9e38, -3e38]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, "vec_id % 5 = 0", 20).collect()}
    for q in (0, 5, 10):
        scores = sorted((-int(np.floor(64 * values[q])) * int(np.floor(64 * v)), i) for i, v in enumerate(values) if i != q)
        assert [found[q, n + 1] for n in range(len(scores))] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scores]


def test_op5_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op5_exact_top_k"]).fetchall())
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op5(spark, DATA).collect()) == want


def test_index_stops_early_and_stays_exact():
    random = np.random.default_rng(8)
    for scale in (1, 1 << 15, 1 << 24):  # the last can't be summed exactly as doubles
        centre = random.integers(-60, 60, (3, 32))
        vectors = np.concatenate([random.integers(-8, 9, (3000, 32)), *(centre[i] + random.integers(-3, 4, (30, 32)) for i in range(3))]) * scale
        ids = random.permutation(len(vectors)).astype(np.int64)
        own = np.array([-1, ids[3005], ids[7]])
        index = topk.ImpactIndex(ids, vectors.astype(np.float64))
        query, got, scores = index.search((centre * scale).astype(np.float64), 20, own)
        for q in range(3):
            exact = vectors.astype(object) @ (centre[q] * scale).astype(object)
            order = sorted((-int(s), i) for s, i in zip(exact, ids.tolist()) if i != own[q])[:20]
            assert [(-s, i) for s, i in zip(np.array(scores, object)[query == q], got[query == q].tolist())] == order
        if scale < 1 << 24:
            assert 0 < index.touched < 0.5 * np.count_nonzero(vectors)  # the proof came long before the small impacts
        else:
            assert len(index.wide_ids) > 0


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    n = 300
    links = {"chain": [(i, i + 1) for i in range(n)], "star": [(n, i) for i in range(n)], "random": [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 500, (260, 2))]}[shape]
    up = {x: x for pair in links for x in pair}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    df = spark.createDataFrame(links, "x long, y long").repartition(7)
    found = {r.node: r.component for r in _common.components(df).collect()}
    linked = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert found == {x: find(x) for x in linked}
    assert _common.components(df.where(F.lit(False))).count() == 0
