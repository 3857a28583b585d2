"""What several operators share: scratch tables, Arrow helpers and connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Whitespace of every word split here: space and the control characters 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tidemark/{sc.applicationId}"


_FOLDERS: set[str] = set()


def _clean(jvm, configuration, folder: str) -> None:
    """Remove this application's scratch tables when Python ends; a folder that can't be reached then stays."""
    with contextlib.suppress(Exception):
        where = jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(configuration).delete(where, True)


def save(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    A task that is lost later is redone from the written files, so partition ids and row numbers kept in the
    table stay what they were. Call :func:`drop` once nothing reads the table any more.
    """
    spark = spark or df.sparkSession
    folder = scratch_dir(spark)
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_clean, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`save` wrote."""
    for t in tables:
        path = getattr(t, "_tidemark_path", None)
        if path:
            jvm, sc = t.sparkSession._jvm, t.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that nothing reads any more; else it waits until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """Python strings of an Arrow string column; bytes that aren't UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose ``column`` holds about ``limit`` bytes (one row may be more)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; nulls are empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    step = base & (2**64 - 1)
    with np.errstate(over="ignore"):
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(pow(step, done, 2**64))
            done += k
    return out


class Rolling:
    """Rabin-Karp hashes modulo 2 ** 64 of many runs of a sequence at once, by prefix sums.

    With ``S[i] = sum(x[t] * base ** -t for t < i)``, the run from a to b hashes to ``(S[b] - S[a]) * base ** a``:
    the same for equal runs wherever they start.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if n > len(self.up):
            self.up, self.down = powers(self.base, n + (n >> 3)), powers(self.inverse, n + (n >> 3))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.down[: n - 1], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (prefix[end] - prefix[start]) * self.up[start]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes from each ``start`` to each ``end``: eight bytes after eight are mixed into the hash so far, which starts from the
    length and ``key``. Where equality hangs on it, use two hashes with random keys."""
    size = end - start
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))  # every byte with the seven after it
    out = mix(size.astype(np.uint64) ^ np.uint64(key))
    rows, at = None, 0  # all, then those that are longer
    while rows is None or len(rows):
        if rows is None:
            out = mix(out ^ (eight[start] & _MASKS[np.minimum(size, 8)]))
        else:
            out[rows] = mix(out[rows] ^ (eight[start[rows] + at] & _MASKS[np.minimum(size[rows] - at, 8)]))
        at += 8
        rows = np.flatnonzero(size > at) if rows is None else rows[size[rows] > at]
    return out


#: A prime; numbers below it are hashed modulo it.
PRIME = (1 << 61) - 1


def _times(a: np.ndarray, b: int) -> np.ndarray:
    """a * b modulo PRIME, for numbers below 2 ** 61, in halves of 32 bits."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    p, al, ah, bl, bh = np.uint64(PRIME), a & low, a >> half, np.uint64(b & 0xFFFFFFFF), np.uint64(b >> 32)
    middle, bottom = ah * bl + al * bh, al * bl
    out = ah * bh * np.uint64(8) + (middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << half) + (bottom & p) + (bottom >> np.uint64(61))
    return _below(out)


def _below(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def window_hashes(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes modulo PRIME of every run of ``width`` values, put together from runs of 1, 2, 4, ... values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    runs, size = {1: _below(values)}, 1
    while 2 * size <= width:
        own = runs[size]
        runs[2 * size] = _below(_times(own[:-size], pow(base, size, PRIME)) + own[size:])
        size *= 2
    out, have = runs[size], size
    while have < width:
        size = 1 << (width - have).bit_length() - 1
        m = n - have - size + 1
        out = _below(_times(out[:m], pow(base, size, PRIME)) + runs[size][have : have + m])
        have += size
    return out


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the rows of a text column, found over the whole Arrow buffer.

    ``start`` and ``end`` are byte positions in ``data``, ``row`` is the row of each word and ``first`` the index of
    each row's first word (one more entry at the end). between: other bytes that part words.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = SPACE):
        self.data, self.offsets = flat(column)
        n = len(self.data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = ~between[self.data]
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = self.offsets[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
        cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # rows that meet without a space between
        if len(cuts):
            start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, self.offsets, side="left")
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def hashes(self, data: np.ndarray | None = None, key: int = 0) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return span_hashes(self.data if data is None else data, self.start, self.end, key)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lowered."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


class Forest:
    """Union-find over the integers 0 to n - 1; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a < b:
            self.up[b] = a
        elif b < a:
            self.up[a] = b


LINKS = "a long, b long"


def contracted(links):
    """A function of batches that gives the links of ``links`` (also one) as a spanning forest of each partition: one Python worker runs both."""
    return lambda batches: _contract(links(batches))


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as a spanning forest: (node, smallest node of its part)."""
    nodes: dict[int, int] = {}
    up: list[int] = []
    ids: list[int] = []

    def find(a: int) -> int:
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for batch in batches:
        for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = (nodes.setdefault(x, len(nodes)) for x in pair)
            while len(up) < len(nodes):
                up.append(len(up))
            while len(ids) < len(nodes):
                ids.append(pair[0] if len(ids) == a else pair[1])
            a, b = find(a), find(b)
            if a != b:
                if ids[a] < ids[b]:
                    up[b] = a
                else:
                    up[a] = b
    out = [(ids[i], ids[find(i)]) for i in range(len(up))]
    for i in range(0, len(out), 50_000):
        part = [x for x in out[i : i + 50_000] if x[0] != x[1]]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], ["a", "b"])


def components(links: DataFrame, name: str = "links", forests: bool = False, most_rounds: int = 60) -> DataFrame:
    """(node long, component long): the smallest node reachable, for every node that has a link.

    links: two long columns. Each partition first contracts its own links to a forest (forests: it has done so), then large-star and
    small-star steps alternate until every node hangs from its component's smallest one. Each step is a grouped
    minimum (combined before the shuffle), written so that the equality join with it has two shuffles of its own and
    Spark can split hot keys; links, nodes and
    labels stay distributed, and each round is a written table. Nulls and self-links are left out.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edges = save((edges if forests else edges.mapInArrow(_contract, LINKS)).distinct(), f"{name}-forest")
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), f"{name}-least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save(large.where("a <> b").distinct(), f"{name}-large")
        drop(edges, least)
        least = save(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"), f"{name}-least")
        small = large.join(least, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = save(small.where("a <> b").distinct(), f"{name}-small")
        drop(large, least)
        edges = small
        if edges.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("n")).where("m <> n").isEmpty():
            parents = edges.select(F.col("b").alias("p")).distinct()
            if edges.join(parents, F.col("a") == F.col("p"), "left_semi").isEmpty():
                break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))


#: So many hot keys are broadcast (the table is counted first); more are joined by shuffle.
FEW_HOT = 4096


def cells(rows: DataFrame, key: str, salt: str, size: int, counted: DataFrame | None = None) -> DataFrame:
    """Deal rows out so that all rows of a key meet pairwise, in groups of bounded size.

    Adds c, lo and hi. A key of at most ``size`` rows is one cell (0, 0). A hotter key is cut by the hash of ``salt`` into
    chunks of about ``size``, and there is a cell for each pair of chunks: a row of chunk c goes to the cells of c and every
    other chunk, so each pair of rows meets in the cell of its two chunks and no cell holds more than two chunks.
    Sorted by key and cell within partitions. Keys are counted with a combine before the shuffle (in ``counted``, a table with the same
    keys, if that is cheaper to read); only hot ones are written and looked up, so rows move once.
    """
    counted = rows if counted is None else counted
    hot = counted.groupBy(F.col(key).alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    hot = save(hot.select("hot", F.ceil(F.col("n") / size).cast("int").alias("chunks")), "hot-keys", rows.sparkSession)
    n = hot.count()
    if not n:
        zero = [F.lit(0).alias(x) for x in ("c", "lo", "hi")]
        return rows.repartition(key).sortWithinPartitions(key).select("*", *zero)
    met = rows.join(F.broadcast(hot) if n <= FEW_HOT else hot, F.col(key) == F.col("hot"), "left")
    met = met.withColumn("c", F.coalesce(F.pmod(F.xxhash64(salt), F.col("chunks")).cast("int"), F.lit(0)))
    met = met.withColumn("x", F.explode(F.when(F.col("chunks") > 1, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.lit(0)))))
    met = met.withColumn("lo", F.least("c", "x")).withColumn("hi", F.greatest("c", "x")).drop("x", "hot", "chunks")
    return met.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def groups(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of rows with equal ``names`` (integer columns, sorted): batches, and where each group in them starts (and the end)."""
    held: list[pa.RecordBatch] = []

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in names:
            v = batch.column(name).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = [batch.column(n)[batch.num_rows - 1] for n in names]
        if len(held) > 1 and [held[0].column(n)[held[0].num_rows - 1] for n in names] == last:
            continue  # still the group that the last batch ended with
        whole = pa.concat_batches(held)
        at = starts(whole)
        if len(at) > 1:
            yield whole.slice(0, at[-1]), at
        held = [whole.slice(at[-1])]
    if held:
        whole = pa.concat_batches(held)
        if whole.num_rows:
            yield whole, np.r_[starts(whole), whole.num_rows]


#: Groups of at most so many rows are compared all at once, by their distance in the sorted rows.
SMALL = 64


def neighbours(starts: np.ndarray, most: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of one group, for the groups of at most ``most`` rows: first all neighbours, then all at a distance of two, ..."""
    length = np.diff(starts)
    end = np.repeat(starts[1:], length)
    row = np.arange(starts[-1])
    row = row[np.repeat((length > 1) & (length <= most), length)]
    apart = 1
    while len(row):
        row = row[row + apart < end[row]]
        if len(row):
            yield row, row + apart
        apart += 1


def large(starts: np.ndarray, most: int = SMALL) -> Iterator[tuple[int, int]]:
    """First row and end of the groups of more than ``most`` rows."""
    for i in np.flatnonzero(np.diff(starts) > most).tolist():
        yield int(starts[i]), int(starts[i + 1])


def forest(n: int, near) -> Iterator[tuple[int, np.ndarray]]:
    """Links that join what is linked among rows 0 to n - 1, at most one for each row. near(i, rows): which rows are linked with i."""
    rest = np.arange(n)
    queue: list[int] = []
    while len(rest):
        if queue:
            i = queue.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        hit = near(i, rest)
        if hit.any():
            found = rest[hit]
            yield i, found
            queue.extend(found.tolist())
            rest = rest[~hit]
