"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters, digits and apostrophes, A-Z lowered), hashed to ``BUCKETS`` numbers.
The machine scores w0 + sum(w[i]) + sum(<v[i], v[j]>) over its terms and pairs of terms, so that it learns pairs that
count together, such as an insult and the mention of a group, beyond what each counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ._common import Words, lower_ascii, slices

BUCKETS = 1 << 18
#: The bounded sample: at most so many labelled rows are learned from, those whose ids have the smallest hashes.
SAMPLE = 20_000
#: Terms are learned whose share among toxic texts is off by so many standard deviations, in at least LEAST texts.
SURE, LEAST = 3.5, 5
#: So are the terms of pairs that are off by PAIR_SURE from what the two terms make expect one by one; pairs are counted among the POOL
#: terms without an effect of their own that are in most texts (a size of the model, like BUCKETS), and only those in over PAIR_LEAST texts.
PAIR_SURE, PAIR_LEAST, POOL = 8.0, 30, 1024
#: One text in so many is left out to learn how scores of unseen texts are scaled.
FOLD = 5
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 6, 30, 256, 0.1, 2e-4, 11

_BETWEEN = np.ones(256, bool)
_BETWEEN[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each distinct hashed term of each text, in order."""
    words = Words(column, _BETWEEN)
    bucket = (words.hashes(lower_ascii(words.data)) >> np.uint64(46)).astype(np.int64)
    both = np.unique(words.row * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Machine:
    """The model: slot[b] is the row of w and v for bucket b, or -1 for a term that counts nothing. Its size is fixed by BUCKETS."""

    slot: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        """The probability of each text being toxic; a null is an empty text."""
        row, bucket = terms(column)
        own = self.slot[bucket]
        row, own = row[own >= 0], own[own >= 0]
        return _sigmoid(_raw(self, own, np.searchsorted(row, np.arange(len(column) + 1)))[0])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between neighbours in ``first``."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[first[1:]] - total[first[:-1]]


def _raw(m: Machine, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = m.v[own]
    s = _sums(v, first)
    return m.w0 + _sums(m.w[own], first) + 0.5 * (s * s - _sums(v * v, first)).sum(axis=1), s


def _paired(row: np.ndarray, bucket: np.ndarray, label: np.ndarray, held: np.ndarray, hit: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Buckets without an effect of their own (not in ``own``) that tell toxic texts together with another such one.

    A pair is held against the additive model: the log odds of its two terms together, less those of all texts.
    """
    n = len(label)
    free = np.setdiff1d(np.flatnonzero((held >= PAIR_LEAST) & (held < n)), own)
    pool = np.sort(free[np.argsort(-np.minimum(held[free], n - held[free]), kind="stable")][:POOL])
    if len(pool) < 2:
        return pool[:0]
    at = np.searchsorted(pool, bucket)
    inside = pool[np.minimum(at, len(pool) - 1)] == bucket
    row, at = row[inside], at[inside]
    both, toxic = (np.zeros((len(pool), len(pool)), np.float32) for _ in range(2))
    for a in range(0, n, 2048):
        use = slice(*np.searchsorted(row, [a, a + 2048]))
        has = np.zeros((min(2048, n - a), len(pool)), np.float32)
        has[row[use] - a, at[use]] = 1
        both += has.T @ has
        has = has[label[a : a + 2048] > 0]
        toxic += has.T @ has
    odds = np.log((hit[pool] + 0.5) / (held[pool] - hit[pool] + 0.5))
    rate = _sigmoid(odds[:, None] + odds[None, :] - np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    off = np.abs(toxic - both * rate) >= PAIR_SURE * np.sqrt(both * rate * (1 - rate))
    off &= both >= PAIR_LEAST
    np.fill_diagonal(off, False)
    return pool[off.any(axis=0)]


def _some(first: np.ndarray, bucket: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of the given texts alone."""
    lengths = first[texts + 1] - first[texts]
    ends = np.r_[0, np.cumsum(lengths)]
    return ends, bucket[np.arange(ends[-1]) + np.repeat(first[texts] - ends[:-1], lengths)]


def fit(first: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Machine:
    """Learn from texts given as runs of distinct buckets (text i: ``first[i]`` to ``first[i + 1]``) and labels 0 or 1.

    A machine learned from all but every FOLD-th text of a random order scores those, which says how raw scores of unseen texts are
    to be scaled and shifted to be probabilities; the machine learned from all texts is scaled and shifted likewise. Without
    both labels, the score is the same for all: (toxic + 0.5) / (all + 2)."""
    machine = _learn(first, bucket, label)
    n = len(label)
    order = np.random.default_rng(SEED + 1).permutation(n)
    unseen, seen = np.sort(order[::FOLD]), np.sort(np.delete(order, np.s_[::FOLD]))
    toxic = label[unseen].sum()
    if min(toxic, len(unseen) - toxic) < PAIR_LEAST or not len(machine.w):
        return machine  # too few to tell
    other = _learn(*_some(first, bucket, seen), label[seen])
    ends, own = _some(first, bucket, unseen)
    row = np.repeat(np.arange(len(unseen)), np.diff(ends))
    own = other.slot[own]
    row, own = row[own >= 0], own[own >= 0]
    slope, shift = _scaled(_raw(other, own, np.searchsorted(row, np.arange(len(unseen) + 1)))[0], label[unseen])
    return Machine(machine.slot, slope * machine.w0 + shift, slope * machine.w, np.sqrt(slope) * machine.v)


def _scaled(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift that make ``sigmoid(slope * raw + shift)`` the likeliest, by Newton steps; labels are drawn in a little, so that both are finite."""
    toxic = label.sum()
    aim = np.where(label > 0, (toxic + 1) / (toxic + 2), 1 / (len(label) - toxic + 2))
    x = np.stack([raw, np.ones(len(raw))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ at)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - aim))
        at = at - np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 and np.isfinite(at).all() else (1.0, 0.0)


def _learn(first: np.ndarray, bucket: np.ndarray, label: np.ndarray) -> Machine:
    """The machine of :func:`fit` before its scores are scaled, by AdaGrad on the logistic loss."""
    n, toxic = len(label), float(label.sum())
    rate = (toxic + 0.5) / (n + 2)
    row = np.repeat(np.arange(n), np.diff(first))
    held = np.bincount(bucket, minlength=BUCKETS)
    hit = np.bincount(bucket, weights=label[row], minlength=BUCKETS)
    mean = toxic / max(n, 1)
    spread = np.sqrt(np.maximum(held * mean * (1 - mean) * (1 - held / max(n, 1)), 1e-9))
    kept = np.flatnonzero((held >= LEAST) & (np.abs(hit - held * mean) >= SURE * spread) & (held < n))
    kept = np.union1d(kept, _paired(row, bucket, label, held, hit, kept))
    slot = np.full(BUCKETS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    random = np.random.default_rng(SEED)
    m = Machine(slot, float(np.log(rate / (1 - rate))), np.zeros(len(kept)), random.normal(0, 0.02, (len(kept), FACTORS)))
    if not len(kept):
        return m
    own = slot[bucket]
    use = own >= 0
    own, row = own[use], row[use]
    first = np.searchsorted(row, np.arange(n + 1))
    g0, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full(m.v.shape, 1e-8)
    for _ in range(EPOCHS):
        order = random.permutation(n)
        for at in range(0, n, BATCH):
            texts = order[at : at + BATCH]
            ends, f = _some(first, own, texts)
            lengths = np.diff(ends)
            raw, s = _raw(m, f, ends)
            off = (_sigmoid(raw) - label[texts]) / len(texts)
            each = np.repeat(off, lengths)
            dw = np.bincount(f, weights=each, minlength=len(kept)) + DECAY * m.w
            dv = each[:, None] * (np.repeat(s, lengths, axis=0) - m.v[f])
            dv = np.stack([np.bincount(f, weights=dv[:, i], minlength=len(kept)) for i in range(FACTORS)], axis=1) + DECAY * m.v
            d0 = off.sum()
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            m.w0 -= RATE * d0 / np.sqrt(g0)
            m.w -= RATE * dw / np.sqrt(gw)
            m.v -= RATE * 0.1 * dv / np.sqrt(gv)
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Learn from at most ``sample`` rows of ``labels`` (doc_id, toxic), never from one whose crc32(doc_id as text) is divisible by 5.

    Nulls in labels are left out. The sample's ids are broadcast (16 bytes each, ``sample`` of them at most) and only its hashed terms reach the driver.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("i"), F.col("toxic").cast("int").alias("toxic")).where("i is not null and toxic in (0, 1)")
    known = known.where(F.crc32(F.col("i").cast("string").cast("binary")) % 5 != 0).orderBy(F.xxhash64("i"), "i", "toxic").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, bucket = terms(batch.column("text"))
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], ["i", "toxic", "terms"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(known), F.col("doc_id") == F.col("i")).select("i", "toxic", "text").mapInArrow(hashed, "i long, toxic int, terms array<int>").toArrow().combine_chunks()
    if not found.num_rows:
        return fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((found["toxic"].to_numpy(), found["i"].to_numpy()))  # the same machine, however Spark dealt the rows
    found = found.take(order).combine_chunks()
    lists = found["terms"].combine_chunks()
    ends = lists.offsets.to_numpy().astype(np.int64)
    return fit(ends - ends[0], lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), found["toxic"].to_numpy().astype(np.float64))


def score_column(text, machine: Machine, spark):
    """double 0 to 1 for a string column, by a trained machine (broadcast; its size does not grow with the data)."""
    model = spark.sparkContext.broadcast(machine)

    @F.arrow_udf(DoubleType())
    def score(batch: pa.Array) -> pa.Array:
        parts = slices([pa.RecordBatch.from_arrays([batch], ["t"])], "t")
        return pa.array(np.concatenate([np.zeros(0), *(model.value.score(p.column(0)) for p in parts)]))

    return score(text)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of documents.

    held_out: crc32(doc_id as text) is divisible by 5, so that its label was not learned (false for a null doc_id).
    A null text is scored as an empty one; equal texts get equal scores; repeated rows stay; without labels all score
    alike, below 0.5; an empty table gives an empty one; other columns are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    found = docs.select("doc_id", held.alias("held_out"), score_column(F.col("text"), train(docs, labels), docs.sparkSession).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10(spark, sf_dir: str) -> DataFrame:
    """The toxicity of all documents."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
