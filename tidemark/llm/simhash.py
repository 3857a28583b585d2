"""SimHash near-dedup by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most four bits, cut into three segments, have a segment in which they differ
by at most one bit. Each fingerprint is therefore indexed under every segment with one bit left out (64 variants); an
equality join on the variants brings together all such pairs, and the whole fingerprints verify them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from ._common import LINKS, cells, components, contracted, forest, groups, large, neighbours, save

SHINGLE, SEED, DISTANCE, BITS = 4, 42, 4, 64
#: A variant that more fingerprints share than this is dealt out as pairs of chunks.
CHUNK = 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text: XXH64 of every run of ``shingle`` words (A-Z lowered, joined by a space), repeats included;
    a bit is 1 if it is set in over half of them. A text of fewer words is one run; no words give 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    hash_ = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_(whole, seed)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(ends) - shingle])]
    found = np.array([hash_(whole[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], "<u8")
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), BITS).sum(axis=0, dtype=np.int32)
    bits = np.packbits(counts * 2 > len(found), bitorder="little")
    return int(bits.view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(batch: pa.Array) -> pa.Array:
    raw = batch.cast(pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary())
    return pa.array(np.array([fingerprint(x.as_py()) for x in raw], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint long): every row's SimHash; null and empty texts have 0. Narrow: no shuffle."""
    return docs.select(F.col(key), _fingerprints(F.col(text)).alias("fingerprint"))


def _variants(column: str, segments: int):
    """Every segment with one bit left out, each as one long that also says which bit it is."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    out = []
    for low, high in zip(cuts, cuts[1:]):
        for bit in range(low, high):
            mask = (1 << high - low) - 1 & ~(1 << bit - low)
            out.append(F.shiftrightunsigned(column, low).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(bit << 32)))
    return F.array(*out)


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in groups(batches, ["variant", "lo", "hi"]):
            value = batch.column("f").to_numpy().view(np.uint64)
            a, b = [], []
            for i, j in neighbours(starts):
                hit = np.bitwise_count(value[i] ^ value[j]) <= distance
                a.append(value[i[hit]])
                b.append(value[j[hit]])
            for start, end in large(starts):
                own = value[start:end]
                for i, found in forest(len(own), lambda i, rest, own=own: np.bitwise_count(own[rest] ^ own[i]) <= distance):
                    a.append(np.full(len(found), own[i]))
                    b.append(own[found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0, np.uint64)]).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(f, component, component_id) for the fingerprints of ``prints`` (doc_id, fingerprint): the smallest doc_id that can be reached
    over links of at most ``distance`` differing bits.

    Equal fingerprints are one node, so copies add nothing to the search. A variant shared by many different
    fingerprints is cut into chunks that meet pairwise; such a cell returns links that join what is linked (at most one
    for each fingerprint), not every pair. Null ids count only where a class has no other.
    """
    segments = distance // 2 + 1  # the fewest of which one differs by at most one bit
    distinct = save(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first_id")), "prints", prints.sparkSession)
    indexed = distinct.select("f", F.explode(_variants("f", segments)).alias("variant"))
    links = cells(indexed, "variant", "f", CHUNK).select("variant", "lo", "hi", "f").mapInArrow(contracted(_verify(distance)), LINKS)
    parts = components(links, "simhash", forests=True)
    known = distinct.join(parts, F.col("f") == F.col("node"), "left").select("f", "first_id", F.coalesce("component", "f").alias("component"))
    known = save(known, "simhash-parts", prints.sparkSession)
    least = save(known.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-least", prints.sparkSession)
    return known.select("f", "component").join(least, "component").select("f", "component", "component_id")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint long, component_id): the near-duplicate class of every row of documents.

    Rows with null or empty texts have fingerprint 0 and are one class, linked like any other; repeated rows are in one
    class; a null doc_id is kept and never is a component_id unless its class has no other; an empty table gives an
    empty one; other columns are ignored.
    """
    prints = save(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "fingerprints", docs.sparkSession)
    return prints.join(classes(prints, distance), F.col("fingerprint") == F.col("f"), "left").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one document of each near-duplicate class: the one with the smallest doc_id, then text hash. All columns stay.

    Of repeated rows one stays; a null doc_id comes last; documents with null or empty texts are one class.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), _fingerprints(F.col("text")).alias("fingerprint"))
    prints = save(rows, "fingerprints", spark)
    found = prints.join(classes(prints, distance), F.col("fingerprint") == F.col("f"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("d"), F.col("k.digest").alias("g"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"))
    stays = whole.join(first, F.col("i").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    one = stays.withColumn("nth", F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(0)))).where("nth = 1")
    return one.select("row.*")


def op7(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
