"""Sharding into parts of nearly equal bytes by histogram sort.

Rows are ordered by a hash of their text, then doc_id, then a row number. For every splitter (the first key of a range) the exact number of
bytes below candidate boundaries is counted across all partitions, and the candidates are refined around the
target, ``BITS`` more bits of the key at a time, until one is within tolerance of it. Then rows move once, into
ranges that are sorted and numbered. DataFrame functions only.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from ._common import drop, save

SHARDS = 24
#: Splitters are accepted within this share of a shard's mean size, and groups of equal texts smaller than it stay whole.
TOLERANCE = 0.002
#: Ranges that a shard is sorted and numbered in, so that a shard may be larger than a task: at least RUNS, and more where a range would have over RUN_ROWS rows.
RUNS, RUN_ROWS = 4, 1 << 22
#: Key bits that one round resolves; fewer where the buckets of a round, one level below all open ones, would be more than 2 ** OPEN.
BITS, OPEN = 10, 20
_PARTS = ("k1", "k2", "k3")
_TOP = 1 << 63


def _key(i: int):
    """Bits 0 to 63 of part i of the key, from the top, as an unsigned order of longs."""
    return F.col(_PARTS[i])


def _prefix(depth: int):
    """The first ``depth`` bits of the key: an array of whole parts and the leading bits of the next one."""
    whole, bits = divmod(depth, 64)
    parts = [_key(i) for i in range(whole)]
    if bits:
        parts.append(F.shiftrightunsigned(_key(whole), 64 - bits))
    return parts


def splitters(keys: DataFrame, targets: list[float], tolerance: float) -> list[tuple[int, ...]]:
    """For each target number of bytes, the first key (k1, k2, k3 as unsigned numbers) of what follows.

    keys: k1, k2, k3 and size. A boundary is a prefix of the key, padded with zeros. Each round counts the bytes of the
    buckets one level below the bucket that holds the target, for all open targets together, in one grouped sum; a target is
    settled when an edge of its bucket is within tolerance, or when the bucket is a single key. Only those sums
    (at most 2 ** OPEN, or two for each open target if that is more) reach the driver; only open buckets, at most one for each target, are broadcast.
    """
    spark = keys.sparkSession
    open_: dict[tuple[int, int], list[tuple[int, int]]] = {(0, 0): [(i, 0) for i in range(len(targets))]}  # (prefix bits, depth) -> (target, bytes below)
    done: dict[int, tuple[int, int]] = {}
    while open_:
        depth = next(iter(open_))[1]
        to = min(depth + max(1, min(BITS, OPEN - (len(open_) - 1).bit_length())), 192)
        rows = keys
        if depth:
            names = [f"o{i}" for i in range(len(_prefix(depth)))]
            held = spark.createDataFrame([tuple(_signed(bits, depth)) for bits, _ in open_], ", ".join(f"{x} long" for x in names))
            rows = keys.join(F.broadcast(held), [p == F.col(x) for p, x in zip(_prefix(depth), names, strict=True)], "left_semi")
        sums = rows.groupBy(*[p.alias(f"p{i}") for i, p in enumerate(_prefix(to))]).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        by_parent: dict[int, list[tuple[int, int, int]]] = {}
        for r in sums:
            bits = _unsigned([r[f"p{i}"] for i in range(len(r) - 2)], to)
            by_parent.setdefault(bits >> to - depth, []).append((bits, r["bytes"], r["n"]))
        following: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (bits, _), wanted in open_.items():
            buckets = sorted(by_parent.get(bits, ()))
            below = [0]
            for _, size, _ in buckets:
                below.append(below[-1] + size)
            for i, before in wanted:
                at = max(0, min(bisect_right(below, targets[i] - before) - 1, len(buckets) - 1))
                if not buckets:
                    done[i] = (bits, depth)
                    continue
                own = buckets[at][0]
                left, right = targets[i] - before - below[at], before + below[at + 1] - targets[i]
                if min(abs(left), abs(right)) <= tolerance or to == 192 or buckets[at][2] == 1:
                    done[i] = (own, to) if abs(left) <= abs(right) else (own + 1, to)
                else:
                    following.setdefault((own, to), []).append((i, before + below[at]))
        open_ = following
    out = []
    for i in range(len(targets)):
        bits, depth = done[i]
        whole = min(bits << 192 - depth, (1 << 192) - 1)
        out.append(tuple(whole >> s & (1 << 64) - 1 for s in (128, 64, 0)))
    return sorted(out)


def _signed(bits: int, depth: int) -> list[int]:
    """A prefix as the longs that :func:`_prefix` gives."""
    whole, rest = divmod(depth, 64)
    out = [bits >> depth - 64 * (i + 1) & (1 << 64) - 1 for i in range(whole)]
    out = [x - (1 << 64) if x >= _TOP else x for x in out]
    return out + [bits & (1 << rest) - 1] if rest else out


def _unsigned(parts: list[int], depth: int) -> int:
    whole, rest = divmod(depth, 64)
    bits = 0
    for x in parts[:whole]:
        bits = bits << 64 | x & (1 << 64) - 1
    return bits << rest | parts[whole] if rest else bits


def shard(docs: DataFrame, shards: int = SHARDS, runs: int | None = None, tolerance: float = TOLERANCE, columns: list[str] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, and ``columns`` of docs): every row with its shard and its place there.

    Size: UTF-8 bytes of the text (a null text has none) plus 8. Shards are ranges of the key order, so equal texts stay
    in one shard unless a splitter falls among a group larger than the tolerance, which is then cut by doc_id. Slots
    number a shard's rows from 0 without gaps. Rows of one doc_id, null ids and repeated rows each have a place of their
    own; an empty table gives no rows; other columns are ignored unless named in ``columns`` (not the names above).
    runs: ranges of a shard, by default as many as the rows ask for. Keys and sizes are written once, so that every round counts the same rows; boundaries and counts by range (shards *
    runs rows, one for RUN_ROWS rows of a large input) are all that is collected or broadcast.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("k1"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
        *(columns or []),
    )
    rows = save(rows, "shard-keys", spark)
    keys = rows.select("k1", "k2", "k3", "size")
    total, n = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    runs = runs or max(RUNS, -(-n // (shards * RUN_ROWS)))
    ranges = shards * runs
    found = splitters(keys, [total * i / ranges for i in range(1, ranges)], tolerance * total / shards)
    return _place(rows, found, shards, runs, columns or [])


def _place(rows: DataFrame, bounds: list[tuple[int, ...]], shards: int, runs: int, columns: list[str]) -> DataFrame:
    """Find each row's range by the leading bits of its key (a table of at most 2 ** BITS rows) and the few splitters among them; exchange; number."""
    spark = rows.sparkSession
    flip = lambda x: (x ^ _TOP) - (1 << 64) if x ^ _TOP >= _TOP else x ^ _TOP  # noqa: E731  unsigned order as signed
    inner: dict[int, list[tuple[int, ...]]] = {}
    for b in bounds:
        inner.setdefault(b[0] >> 64 - BITS, []).append(tuple(map(flip, b)))
    table, below = [], 0
    for top in range(1 << BITS):
        own = inner.get(top, [])
        table.append((top, below, own))
        below += len(own)
    lookup = spark.createDataFrame(table, "top int, below int, inner array<struct<a:long,b:long,c:long>>")
    unsigned = [F.col(p).bitwiseXOR(F.lit(-(1 << 63))) for p in _PARTS]
    key = F.struct(unsigned[0].alias("a"), unsigned[1].alias("b"), unsigned[2].alias("c"))
    dealt = rows.withColumn("top", F.shiftrightunsigned("k1", 64 - BITS).cast("int")).withColumn("key", key)
    dealt = dealt.join(F.broadcast(lookup), "top").withColumn("range", (F.col("below") + F.size(F.filter("inner", lambda s: s <= F.col("key")))).cast("int"))
    before, at = [], 0
    counts = {r["range"]: r["n"] for r in dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    for r in range(shards * runs):
        at = 0 if r % runs == 0 else at
        before.append((r, at))
        at += counts.get(r, 0)
    earlier = F.broadcast(spark.createDataFrame(before, "r int, earlier long"))
    order = Window.partitionBy("range").orderBy("key")
    out = dealt.withColumn("place", F.row_number().over(order)).join(earlier, F.col("range") == F.col("r"))
    return out.select("doc_id", "size", "text_crc32", F.floor(F.col("range") / runs).cast("int").alias("shard"), (F.col("earlier") + F.col("place") - 1).alias("slot"), *columns)


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
