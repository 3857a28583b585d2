"""Exact top-k search by an impact-ordered, score-at-a-time index.

Components are quantised to integers; a component's size is its impact. In a block of vectors the postings (vector,
dimension, value) are kept in segments by quantised impact, and segments are worked from high impact to low, each for
a whole part of the queries at once. When all impacts above a level are done, a score lies within level * sum(|q|), over the
dimensions in which the vector has not been seen yet, of what it has. Work stops once that proves all but a few vectors out of
the k best, and those few are scored exactly; without proof it goes on to the last segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._common import groups

SCALE, TOP = 64.0, 20
#: Vectors of one block, queries that meet it in one task (over one index), and those that are worked at once.
BLOCK, QUERIES, AT_ONCE = 4096, 4096, 256
#: Possible members may be this many times k when work stops; only speed depends on it.
FEW = 8
#: Lower bounds of the quantised impacts, from high to low, as shares of the block's largest component.
LEVELS = (1 / 2, 1 / 3, 1 / 4, 1 / 6, 1 / 8, 1 / 12, 1 / 24, 0)
#: A proof is tried from this share of the largest impact down.
PROOF = 8
#: Sums up to this are exact as doubles.
EXACT = float(1 << 53)
#: Scores are longs; one beyond is given as the nearest long, but ranked by its exact value.
LONGEST = (1 << 63) - 1


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as Python integers."""
    out = np.empty(vectors.shape, object)
    out.reshape(-1)[:] = [int(x) for x in vectors.reshape(-1).tolist()]
    return out


class ImpactIndex:
    """The postings of a block of vectors of whole numbers (as doubles) in segments by quantised impact.

    Vectors with components so large that scores may not be exact as doubles are left out of the segments; they, and all vectors for a
    query of such components, are scored in Python's integers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.limit = float(int((EXACT / max(vectors.shape[1], 1)) ** 0.5))
        plain = np.abs(vectors).max(axis=1, initial=0) <= self.limit
        self.wide_ids, self.wide = ids[~plain], _exact(vectors[~plain])
        self.ids, self.vectors = ids[plain], vectors[plain]
        size = np.abs(self.vectors)
        self.largest = int(size.max(initial=0))
        self.bounds = sorted({int(self.largest * share) for share in LEVELS}, reverse=True)
        self.segments, above = [], self.largest + 1
        for bound in self.bounds:
            least = bound if bound else 1  # a component of 0 adds nothing
            row, dimension = np.nonzero((size >= least) & (size < above))
            self.segments.append((row, dimension, self.vectors[row, dimension]))
            above = least
        self.touched = 0  # postings worked, for all queries at once

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(query, ids, scores) of the k best vectors for each row of ``queries``, none of which has the id in ``own``; ties go to smaller ids."""
        plain = np.abs(queries).max(axis=1, initial=0) <= self.limit
        member = self._members(queries[plain], k, own[plain])
        at = np.cumsum(plain) - 1
        out: list[tuple[int, int, int]] = []
        every = _exact(self.vectors) if len(queries) and not plain.all() else None
        for q in range(len(queries)):
            if plain[q]:
                rows = np.flatnonzero(member[at[q]])
                scores = (self.vectors[rows] @ queries[q]).astype(np.int64)
                best = np.lexsort((self.ids[rows], -scores))[:k]
                found = list(zip((-scores[best]).tolist(), self.ids[rows[best]].tolist(), strict=True))
            else:
                found = self._scored(every, self.ids, queries[q], own[q])
            found = sorted(found + self._scored(self.wide, self.wide_ids, queries[q], own[q]))[:k]
            out += [(q, i, -s) for s, i in found]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return np.array(columns[0], np.int64), np.array(columns[1], np.int64), list(columns[2])

    @staticmethod
    def _scored(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int) -> list[tuple[int, int]]:
        """(-score, id) of all vectors but the query's own, in Python's integers."""
        ask = _exact(query)
        return [(-int(s), i) for s, i in zip((vectors * ask).sum(axis=1).tolist() if len(ids) else [], ids.tolist(), strict=True) if i != own]

    def _members(self, queries: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Which vectors may be among the k best of each query: scores so far and what is not seen yet prove the others out."""
        n, d = self.vectors.shape
        left_out = [(i, np.flatnonzero(own == self.ids[i])) for i in np.flatnonzero(np.isin(self.ids, own)).tolist()]
        member = np.ones((len(queries), n), bool)
        for i, q in left_out:
            member[q, i] = False
        if n <= k or not len(queries):
            return member
        have, unseen = np.zeros((len(queries), n)), np.ones((n, d))
        for (row, dimension, value), bound in zip(self.segments, self.bounds, strict=True):
            if len(row):
                postings = np.zeros((n, d))
                postings[row, dimension] = value
                have += queries @ postings.T
                unseen[row, dimension] = 0
                self.touched += len(row)
            if bound * PROOF > self.largest:
                continue
            slack = (np.abs(queries) * max(bound - 1, 0)) @ unseen.T  # what is not seen is smaller than the bound
            low = have - slack
            for i, q in left_out:
                low[q, i] = -np.inf
            worst = np.partition(low, n - k, axis=1)[:, n - k]
            possible = have + slack >= worst[:, None]
            if not bound or np.count_nonzero(possible) <= k * FEW * len(queries):
                return member & possible
        return member


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones are padded with zeros."""
    ends = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    out = np.zeros((len(column), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = values
    return out


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in groups(batches, ["block", "part"]):
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                cell = batch.slice(start, end - start)
                ids, asks, vectors = cell.column("vec_id").to_numpy(), cell.column("asks").to_numpy(zero_copy_only=False), _matrix(cell.column("q"))
                index, asking = ImpactIndex(ids[~asks], vectors[~asks]), np.flatnonzero(asks)
                for at in range(0, len(asking), AT_ONCE):
                    own = asking[at : at + AT_ONCE]
                    query, best, score = index.search(vectors[own], k, ids[own])
                    exact = [str(x) for x in score]
                    near = [max(-LONGEST - 1, min(LONGEST, x)) for x in score]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own][query]), pa.array(best), pa.array(near, pa.int64()), pa.array([x if abs(y) >= LONGEST else None for x, y in zip(exact, near, strict=True)], pa.string())], ["query_id", "vec_id", "score", "beyond"])

    return run


def top_k(vectors: DataFrame, queries: str, k: int = TOP, scale: float = SCALE, block: int = BLOCK, part: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of ``vectors`` (vec_id, embedding) for each row that meets
    the SQL condition ``queries`` on vec_id.

    Score: inner product of components floor(scale * x), as exact integers; ties go to the smaller vec_id. A score that no long holds is
    given as the nearest long, and ranked exactly. Vectors that are null or hold null or non-finite components (also once scaled), and
    rows without a vec_id, take no part. Shorter vectors count as
    padded with zeros. All rows of a query's own vec_id are left out for it; of other repeated rows each counts.
    An empty table gives no rows; other columns are ignored. Rows are dealt into blocks and queries into parts of bounded size,
    each block meets each part in one task, and only k rows of each come back, so neither side is ever
    broadcast or gathered whole.
    """
    sound = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(sound)
    scaled = F.transform("embedding", lambda x: F.lit(scale) * x)
    rows = rows.withColumn("scaled", scaled).where("forall(scaled, x -> abs(x) < double('infinity'))")
    step = F.transform("scaled", lambda x: F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x))  # doubles from 2 ** 53 on are whole
    rows = rows.select("vec_id", step.alias("q"))
    n, asked = vectors.select(F.count(F.lit(1)), F.count_if(F.expr(queries))).first()
    blocks, parts = max(1, -(-n // block)), max(1, -(-asked // part))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "q"), F.lit(n)).cast("int")
    index = rows.select("vec_id", "q", own(blocks).alias("block"), every(parts).alias("part"), F.lit(False).alias("asks"))
    asking = rows.where(queries).select("vec_id", "q", every(blocks).alias("block"), own(parts).alias("part"), F.lit(True).alias("asks"))
    dealt = index.union(asking).repartition("block", "part").sortWithinPartitions("block", "part")
    found = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long, beyond string")
    size = F.coalesce(F.length("beyond"), F.lit(0))
    above = F.col("score") > 0
    exact = [F.desc("score"), F.when(above, -size).otherwise(size), F.when(above, F.col("beyond")).desc(), F.when(~above, F.col("beyond")).asc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*exact)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every row whose vec_id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
