"""Near-dedup of embeddings by Euclidean p-stable hashing.

Vectors are normalised, so that cosine c is the distance sqrt(2 - 2c). Each of ``tables`` tables hashes a vector by
``functions`` random projections, each shifted and cut into buckets of ``width``; vectors that share all of a table's
buckets are compared exactly, by cosine in double precision. Of unit vectors at cosine 0.93 (distance 0.374) one
projection separates about 15 percent at width 2, so 12 of them keep a pair together in one table with probability
0.145, and 24 tables miss it with probability 0.023; closer pairs are missed less. Vectors of other directions
share a bucket of one table about once in 5,000 pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import cells, components, forest, groups, large, mix, neighbours, save

TABLES, FUNCTIONS, WIDTH, COSINE, SEED = 24, 12, 2.0, 0.93, 7
#: A bucket of more vectors than this is dealt out as pairs of chunks.
CHUNK = 1024


@lru_cache(maxsize=8)
def _projections(dimension: int, tables: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng([seed, dimension, tables, functions])
    n = tables * functions
    return random.standard_normal((dimension, n)) / width, random.random(n), random.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def bucket_ids(vectors: np.ndarray, tables: int, functions: int, width: float, seed: int) -> np.ndarray:
    """The bucket (one 64-bit number) of each unit vector in each table."""
    lines, shift, odd = _projections(vectors.shape[1], tables, functions, width, seed)
    steps = np.floor(vectors @ lines + shift).astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix((mix(steps + np.uint64(0x9E3779B97F4A7C15)) * odd).reshape(len(vectors), tables, functions).sum(axis=2, dtype=np.uint64))


def _hash(tables: int, functions: int, width: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, sizes, labels = (part.column(n).to_numpy() for n in ("cid", "size", "label"))
                vectors = [np.array(v, np.float64) for v in part.column("embedding").to_pylist()]
                for dimension in sorted({len(v) for v in vectors}):
                    own = np.array([i for i, v in enumerate(vectors) if len(v) == dimension])
                    unit = np.array([vectors[i] for i in own])
                    unit /= np.abs(unit).max(axis=1, keepdims=True)  # no overflow of squares
                    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                    found = bucket_ids(unit, tables, functions, width, seed)
                    n = len(own)
                    # the label, the dimension and the table are part of the bucket's key
                    with np.errstate(over="ignore"):
                        salt = labels[own].astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(dimension)
                        key = mix(found ^ mix(salt)[:, None] ^ mix(np.arange(1, tables + 1, dtype=np.uint64))[None, :])
                    raw = pa.array([v.tobytes() for v in unit], pa.binary())
                    keys = pa.array([k.tobytes() for k in key], pa.binary())
                    row = pa.array(np.repeat(np.arange(n), tables))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(ids[own]).take(row), pa.array(sizes[own]).take(row), pa.array(labels[own]).take(row), raw.take(row), keys.take(row)],
                        ["bucket", "table", "cid", "size", "label", "unit", "keys"],
                    )

    return run


def _verify(cosine: float):
    """Of each cell: (a, b) links that join what is linked, and (a, n) how many vectors a is linked with in this cell. A
    pair is counted in the first table that brings it together, and in the cell of its two chunks only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in groups(batches, ["bucket", "lo", "hi"]):
            ids, sizes, labels = (batch.column(n).to_numpy() for n in ("cid", "size", "label"))
            table, chunk, lo, hi = (batch.column(n).to_numpy() for n in ("table", "c", "lo", "hi"))
            raw, raw_keys = batch.column("unit").to_pylist(), batch.column("keys").to_pylist()
            lengths = np.array([len(x) for x in raw])
            counts = np.zeros(batch.num_rows, np.int64)
            a, b = [], []

            def matrix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                return np.frombuffer(b"".join([raw[i] for i in rows]), np.float64).reshape(len(rows), -1), np.frombuffer(b"".join([raw_keys[i] for i in rows]), np.uint64).reshape(len(rows), -1)

            for dimension in np.unique(lengths):  # of the whole batch at once, for groups of a few rows
                unit, key = matrix(np.flatnonzero(lengths == dimension))
                at = np.cumsum(lengths == dimension) - 1
                for i, j in neighbours(starts):
                    own = (lengths[i] == dimension) & (lengths[j] == dimension) & (labels[i] == labels[j])
                    own &= (chunk[i] != chunk[j]) | (lo[i] == hi[i])
                    i, j = i[own], j[own]
                    hit = np.einsum("ij,ij->i", unit[at[i]], unit[at[j]]) >= cosine
                    i, j = i[hit], j[hit]
                    a.append(ids[i])
                    b.append(ids[j])
                    earlier = np.arange(key.shape[1])[None, :] < table[i][:, None]
                    first = ~((key[at[i]] == key[at[j]]) & earlier).any(axis=1)
                    np.add.at(counts, i[first], sizes[j[first]])
                    np.add.at(counts, j[first], sizes[i[first]])
            for start, end in large(starts):
                for dimension in np.unique(lengths[start:end]):
                    rows = start + np.flatnonzero(lengths[start:end] == dimension)
                    unit, key = matrix(rows)
                    near = (unit @ unit.T) >= cosine
                    near &= labels[rows][:, None] == labels[rows][None, :]
                    np.fill_diagonal(near, False)
                    for i, found in forest(len(rows), lambda i, rest, near=near: near[i, rest]):
                        a.append(np.full(len(found), ids[rows[i]]))
                        b.append(ids[rows[found]])
                    if lo[start] != hi[start]:
                        near &= chunk[rows][:, None] != chunk[rows][None, :]
                    for t in range(int(table[start])):
                        near &= key[:, t][:, None] != key[:, t][None, :]
                    counts[rows] += near @ sizes[rows]
            some = np.flatnonzero(counts)
            a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[a, ids[some]]), pa.array(np.r_[b, np.zeros(len(some), np.int64)], mask=np.r_[np.zeros(len(a), bool), np.ones(len(some), bool)]), pa.array(np.r_[np.zeros(len(a), np.int64), counts[some]])],
                ["a", "b", "n"],
            )

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null, they have the same number of components, and their
    cosine is ``cosine`` or more. Vectors that are null, empty or zero, or hold null or non-finite components, have no links: n_links 0,
    their own vec_id, kept. Equal vectors of one label are one node that weighs as many rows, so copies cost
    nothing and count fully; rows of one vec_id are different vectors. A null vec_id is never smaller than another. An empty
    table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    sound = "label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    distinct = rows.where("sound").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    nodes = save(distinct.withColumn("cid", F.monotonically_increasing_id()), "vectors", spark)
    hashed = nodes.select("cid", "size", "label", "embedding").mapInArrow(_hash(tables, functions, width, seed), "bucket long, table int, cid long, size long, label long, unit binary, keys binary")
    met = cells(hashed, "bucket", "cid", CHUNK).select("bucket", "lo", "hi", "c", "table", "cid", "size", "label", "unit", "keys")
    found = save(met.mapInArrow(_verify(cosine), "a long, b long, n long"), "vector-links", spark)
    counts = found.where("b is null").groupBy(F.col("a").alias("i")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null").select("a", "b"), "vectors")
    known = nodes.join(counts, F.col("cid") == F.col("i"), "left").join(parts, F.col("cid") == F.col("node"), "left")
    known = save(known.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("component"), "first_id"), "vector-classes", spark)
    least = save(known.groupBy("component").agg(F.min("first_id").alias("least_id")), "vector-least", spark)
    known = known.join(least, "component").select("l", "e", "links", "least_id")
    out = rows.join(known, F.col("sound") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.when(F.col("sound"), F.col("least_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
