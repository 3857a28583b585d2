"""A versioned store of sorted runs: atomic writes, reads at any snapshot, flush, compaction and vacuum.

Every batch is one commit. Committed rows go to runs in level 0; compaction merges runs downwards and drops
versions that no snapshot can see. Views are DataFrames over the run files of one manifest version, so they stay what
they were while others write.
"""

from __future__ import annotations

import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..errors import Corruption, Frozen, InvalidArgument, NotFound
from ..operators import compaction, levels, views
from ..operators.batch import WriteBatch, assign_sequences
from ..operators.ordering import union
from ..options import DELETE, LEVELS, MAX_KEY_BYTES, MAX_SEQUENCE, Options
from .manifest import Folder, Manifest, Run, at_version, current, publish, versions


class Snapshot:
    """A pinned sequence: compaction keeps what it sees until it is released."""

    def __init__(self, sequence: int):
        self.sequence = sequence


class Store:
    """Open with :meth:`open`. ``schema``: the key's column first, then the payload's."""

    def __init__(self, spark: SparkSession, folder: Folder | None, schema: StructType, options: Options, manifest: Manifest):
        self.spark, self.folder, self.schema, self.options = spark, folder, schema, options
        self.key = schema.fields[0].name
        self.names = views.Names(self.key, "seq", "t")
        self._manifest, self._snapshots, self._pinned, self._closed = manifest, [], {}, False
        self._memory: dict[int, DataFrame] = {}
        self.counters = {"gets": 0, "runs_checked": 0, "runs_skipped": 0}

    # --- life cycle -----------------------------------------------------------------------------------------------

    @staticmethod
    def open(spark: SparkSession, path: str | None, schema: StructType, options: Options | None = None) -> Store:
        """Open or create a store; without a path, one in memory. Opening deletes nothing, so a commit under way elsewhere goes on; :meth:`vacuum` clears up."""
        names = [f.name for f in schema.fields]
        if not names or {"seq", "t", "ord"} & set(names):
            raise InvalidArgument("the schema needs a key, and no column called seq, t or ord")
        options = options or Options()
        if path is None:
            return Store(spark, None, schema, options, Manifest())
        folder = Folder(spark, path)
        if not folder.exists("CURRENT") and not folder.list("runs"):
            folder.write(f"manifest/{0:020d}.json", Manifest().to_json(), overwrite=True)
            folder.swap("CURRENT", "0\n")
        manifest = current(folder)
        store = Store(spark, folder, schema, options, manifest)
        if options.verify:
            store.verify()
        return store

    def verify(self) -> None:
        """Every registered run must be there with its rows and its largest sequence, and every page of it must have its checksum."""
        for r in self._manifest.runs:
            if self.folder is not None and not self.folder.exists(f"runs/{r.path}"):
                raise Corruption(f"run {r.number} is missing")
        if not self._manifest.runs:
            return
        columns = [F.col(f.name).cast("string") if f.dataType.typeName() in ("map", "array", "struct") else f.name for f in self._run_schema().fields]
        rows = union([self._read([r], check=True).select(F.lit(r.number).alias("n"), "seq", F.xxhash64(*columns).alias("h")) for r in self._manifest.runs])
        try:  # the hash makes all pages be read
            sums = rows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("most"), F.bit_xor("h").alias("h")).collect()
        except (PySparkException, Py4JJavaError) as e:
            if "FAILED_READ_FILE" not in str(e):
                raise
            raise Corruption(f"a run can't be read: {str(e).splitlines()[0][:200]}") from e
        found = {x["n"]: (x["rows"], x["most"]) for x in sums}
        for r in self._manifest.runs:
            if found.get(r.number) != (r.n_entries, r.max_sequence):
                raise Corruption(f"run {r.number} doesn't hold what the manifest says")

    def close(self) -> None:
        """No further reads or writes; closing again does nothing. Every write that returned is durable already."""
        self._closed = True
        for df in self._memory.values():
            df.unpersist()

    def sync(self) -> int:
        """The last durable sequence: a write is durable when it returns."""
        self._open()
        return self._manifest.last_sequence

    def _open(self) -> None:
        if self._closed:
            raise Frozen("the store is closed")

    # --- writes ---------------------------------------------------------------------------------------------------

    def put(self, key, *payload) -> int:
        return self.write(WriteBatch().put(key, payload))

    def delete(self, key) -> int:
        return self.write(WriteBatch().delete(key))

    def write(self, batch: WriteBatch) -> int:
        """Commit a batch, all or nothing; its last sequence."""
        self._open()
        batch.validate()
        batch.sequence = self._manifest.last_sequence + 1
        return self.write_frame(batch.frame(self.spark, self.schema), ["ord"])

    def write_frame(self, mutations: DataFrame, order: list[str], batch_id: tuple[str, int] | None = None) -> int:
        """Commit a DataFrame of mutations (t, the key and the payload) in the order of the columns ``order``.

        batch_id: (stream, number); a number at or below the stream's last one was committed before and does nothing. A store in
        memory whose runs fill ``write_buffer_size`` is frozen.
        """
        self._open()
        if self.folder is None and sum(r.file_size for r in self._manifest.runs) >= self.options.write_buffer_size:
            raise Frozen("the store's memory is full")
        if batch_id and batch_id[1] <= self._manifest.batches.get(batch_id[0], -1):
            return self._manifest.last_sequence
        staged = mutations = self._staged(mutations) if self.folder is not None else mutations.persist()  # read several times, evaluated once
        self._check(mutations)
        numbered = assign_sequences(mutations, order, self._manifest.last_sequence).select("seq", "t", *[f.name for f in self.schema.fields])
        payload = [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) for f in self.schema.fields]
        run, frame = self._write_run(numbered, 0, self._manifest.next_number)
        batches = {**self._manifest.batches, **({batch_id[0]: batch_id[1]} if batch_id else {})}
        if run is None:
            self._publish(self._manifest.edit(set(), [], batches=batches))
            self._unstage(staged)
            return self._manifest.last_sequence
        user = frame.agg(F.sum(sum(payload[1:], payload[0]))).first()[0] or 0
        if run.max_sequence > MAX_SEQUENCE:
            raise InvalidArgument("sequences are used up")
        self._publish(self._manifest.edit(set(), [run], last_sequence=run.max_sequence, next_number=run.number + 1, batches=batches, user_bytes=self._manifest.user_bytes + user, flushed_bytes=self._manifest.flushed_bytes + run.file_size))
        if self.folder is not None:
            self._unstage(staged)
        if self.folder is not None and self._small() and sum(r.file_size for r in self._small()) >= self.options.write_buffer_size:
            self.flush()
        return run.max_sequence

    def _small(self) -> list[Run]:
        return [r for r in self._manifest.runs if r.level == 0 and r.file_size < self.options.write_buffer_size]

    def _check(self, mutations: DataFrame) -> None:
        size = F.octet_length(F.col(self.key).cast("string")) if self.schema[0].dataType.typeName() != "binary" else F.octet_length(self.key)
        bad = mutations.where(F.col(self.key).isNull() | (size == 0) | (size > MAX_KEY_BYTES) | F.col("t").isNull() | ~F.col("t").isin(0, 1))
        if not bad.isEmpty():
            raise InvalidArgument("a mutation has no key, a key of no or too many bytes, or no valid kind")

    def _run_schema(self) -> StructType:
        return StructType([StructField("seq", LongType()), StructField("t", IntegerType()), *self.schema.fields])

    def _write_run(self, rows: DataFrame, level: int, number: int) -> tuple[Run | None, DataFrame]:
        """Write sorted rows as a run and read its statistics back; no run for no rows."""
        name = f"run-{number:06d}-{uuid.uuid4().hex[:8]}"
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._run_schema().fields])
        if self.folder is None:
            frame = shaped.persist()
            self._memory[number] = frame
            size = frame.count() * 64
        else:
            self._writer(shaped.repartitionByRange(self.key)).parquet(f"{self.folder.path}/runs/{name}")
            frame = self.spark.read.schema(self._run_schema()).parquet(f"{self.folder.path}/runs/{name}")
            size = self.folder.size(f"runs/{name}")
        found = compaction.file_metadata(frame.withColumn("run", F.lit(number)), names=self.names).first()
        if found is None:
            if self.folder is not None:
                self.folder.delete(f"runs/{name}")
            return None, frame
        ends = [tuple(found[f"{side}_{x}"] for x in ("k", "seq", "t")) for side in ("smallest", "largest")]
        return Run(level, number, name, found["n_entries"], size, found["max_sequence"], *ends), frame

    def _publish(self, new: Manifest) -> None:
        if self.folder is not None:
            publish(self.folder, self._manifest, new)
        self._manifest = new

    # --- reads ----------------------------------------------------------------------------------------------------

    def _read(self, runs: list[Run], check: bool = False) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self._run_schema())
        if self.folder is None:
            return union([self._memory[r.number] for r in runs])
        reader = self.spark.read.schema(self._run_schema()).option("parquet.page.verify-checksum.enabled", str(check).lower())
        return reader.parquet(*[f"{self.folder.path}/runs/{r.path}" for r in runs])

    def log(self, low: Any = None, high: Any = None) -> DataFrame:
        """All versions of the runs whose key range touches [low, high]; None is open. Runs outside are not even listed."""
        self._open()
        near = [r for r in self._manifest.runs if (low is None or r.largest[0] >= low) and (high is None or r.smallest[0] <= high)]
        self.counters["runs_checked"] += len(near)
        self.counters["runs_skipped"] += len(self._manifest.runs) - len(near)
        return self._read(near)

    def _as_of(self, snapshot: Snapshot | int | None) -> int:
        s = snapshot.sequence if isinstance(snapshot, Snapshot) else snapshot
        return self._manifest.last_sequence if s is None else s

    def scan(self, low=None, high=None, snapshot: Snapshot | int | None = None) -> DataFrame:
        """The live rows with low <= key < high at the snapshot: key and payload."""
        found = views.range_scan(self.log(low, high), low, high, self._as_of(snapshot), self.names)
        return found.select(*[f.name for f in self.schema.fields])

    def reverse(self, limit: int, below=None, snapshot: Snapshot | int | None = None) -> DataFrame:
        found = views.reverse_scan(self.log(None, below), limit, below, self._as_of(snapshot), self.names)
        return found.select(*[f.name for f in self.schema.fields])

    def prefix(self, prefix, snapshot: Snapshot | int | None = None) -> DataFrame:
        found = views.prefix_scan(self.log(prefix, _after(prefix)), prefix, self._as_of(snapshot), self.names)
        return found.select(*[f.name for f in self.schema.fields])

    def get(self, key, snapshot: Snapshot | int | None = None) -> tuple:
        """The payload of a live key; raises NotFound."""
        if key is None:
            raise InvalidArgument("a key is needed")
        self.counters["gets"] += 1
        row = views.get(self.log(key, key), key, self._as_of(snapshot), self.names).select(*[f.name for f in self.schema.fields[1:]]).first()
        if row is None:
            raise NotFound(key)
        return tuple(row)

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | int | None = None) -> DataFrame:
        """key, status and payload for each distinct key of a one-column DataFrame."""
        ends = keys.agg(F.min(keys.columns[0]), F.max(keys.columns[0])).first()
        return views.multi_get(self.log(ends[0], ends[1]), keys, self._as_of(snapshot), self.names)

    def changes(self, after: Snapshot | int, upto: Snapshot | int | None, value: str) -> DataFrame:
        return views.changes(self.log(), self._as_of(after), self._as_of(upto), value, self.names)

    def iterator(self, snapshot: Snapshot | int | None = None) -> Cursor:
        return Cursor(self, self._as_of(snapshot))

    def snapshot(self) -> Snapshot:
        self._open()
        s = Snapshot(self._manifest.last_sequence)
        self._snapshots.append(s)
        return s

    def release(self, snapshot: Snapshot) -> None:
        if snapshot in self._snapshots:
            self._snapshots.remove(snapshot)

    def smallest_snapshot(self) -> int:
        return min([s.sequence for s in self._snapshots], default=self._manifest.last_sequence)

    def pin(self) -> int:
        """Keep the files of the present version until :meth:`unpin`, whoever vacuums the folder; the version's number."""
        v = self._manifest.version
        own = self._pinned.setdefault(v, [self._manifest, 0, f"pins/{v:020d}-{uuid.uuid4().hex}"])
        if self.folder is not None and not own[1]:
            self.folder.write(own[2], "")
        own[1] += 1
        return v

    def unpin(self, version: int) -> None:
        if version in self._pinned:
            self._pinned[version][1] -= 1
            if not self._pinned[version][1]:
                if self.folder is not None:
                    self.folder.delete(self._pinned[version][2])
                del self._pinned[version]

    # --- maintenance ----------------------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """The manifest as files: level, number, lo, hi, size."""
        kind = self.schema[0].dataType
        schema = StructType([StructField("level", IntegerType()), StructField("number", LongType()), StructField("lo", kind), StructField("hi", kind), StructField("size", LongType())])
        return self.spark.createDataFrame([(r.level, r.number, r.smallest[0], r.largest[0], r.file_size) for r in self._manifest.runs], schema)

    def flush(self) -> bool:
        """Rewrite the level-0 runs that are smaller than the write buffer as one, with all versions and deletes. False if there are not two.

        A commit after which they add up to the write buffer does so by itself."""
        self._open()
        small = self._small()
        if len(small) < 2:
            return False
        m = self._manifest
        run, _ = self._write_run(self._read(small).dropDuplicates([self.key, "seq", "t"]), 0, m.next_number)
        self._publish(m.edit({r.number for r in small}, [run], next_number=m.next_number + 1, flushed_bytes=m.flushed_bytes + run.file_size))
        return True

    def compact(self, level: int | None = None) -> bool:
        """One round: pick a level that is due (or take ``level``), merge as much of it as makes it due no longer (one seed at least), drop what no snapshot sees. False if nothing is due."""
        self._open()
        files = self.files()
        if level is None:
            level = levels.pick_level(files, self.options).first()["level"]
        if level < 0 or level >= LEVELS - 1:
            return False
        chosen = {r["number"] for r in levels.inputs(files, level, levels.pick_seeds(files, level, self.options)).select("number").collect()}
        if not chosen:
            return False
        taken = [r for r in self._manifest.runs if r.number in chosen]
        deeper = any(r.level >= level + 2 for r in self._manifest.runs)
        log = levels.base_level(self._read(taken), self.key, files, level) if deeper else self._read(taken).withColumn("base", F.lit(True))
        judged = compaction.judged(log, self.smallest_snapshot(), "base", self.names)
        if self.folder is not None:
            judged = self._staged(judged)
        else:
            judged = judged.persist()
        gone = judged.where("drop").agg(F.count_if(F.col("t") == 1), F.count_if(F.col("t") == DELETE)).first()
        kept = judged.where("not drop").drop("drop", "base")
        parts = max(1, -(-sum(r.file_size for r in taken) // self.options.max_file_size))
        added, number = self._write_pieces(kept, parts, level + 1, self._manifest.next_number)
        written = sum(r.file_size for r in added)
        m = self._manifest
        self._publish(m.edit(chosen, added, next_number=number, compacted_bytes=m.compacted_bytes + written, dropped_old=m.dropped_old + gone[0], dropped_tombstones=m.dropped_tombstones + gone[1]))
        self._unstage(judged)
        return True

    def _unstage(self, df: DataFrame) -> None:
        if self.folder is None:
            df.unpersist()
        else:
            self.folder.delete(f"staging/{df._tidemark_name}")

    def _staged(self, df: DataFrame) -> DataFrame:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder.path}/staging/{name}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder.path}/staging/{name}")
        out._tidemark_name = name
        return out

    def _write_pieces(self, rows: DataFrame, parts: int, level: int, number: int) -> tuple[list[Run], int]:
        """Runs of disjoint key ranges, one for each file of a single sorted write (a key is never in two), and the next number."""
        if self.folder is None or parts == 1:
            run, _ = self._write_run(rows, level, number)
            return ([run], number + 1) if run else ([], number)
        name = f"run-{number:06d}-{uuid.uuid4().hex[:8]}"
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._run_schema().fields])
        self._writer(shaped.repartitionByRange(parts, self.key)).parquet(f"{self.folder.path}/runs/{name}")
        frame = self.spark.read.schema(self._run_schema()).parquet(f"{self.folder.path}/runs/{name}")
        found = compaction.file_metadata(frame.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -1)), names=self.names).collect()
        added = []
        for x in sorted(found, key=lambda x: x["smallest_k"]):
            ends = [tuple(x[f"{side}_{y}"] for y in ("k", "seq", "t")) for side in ("smallest", "largest")]
            path = f"{name}/{x['number']}"
            added.append(Run(level, number + len(added), path, x["n_entries"], self.folder.size(f"runs/{path}"), x["max_sequence"], *ends))
        return added, number + len(added)

    def _writer(self, rows: DataFrame):
        writer = rows.sortWithinPartitions(F.col(self.key), F.desc("seq"), F.desc("t")).write.option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom_bits:
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.key}", str(self.options.expected_keys)).option(f"parquet.bloom.filter.fpp#{self.key}", str(max(0.6185**self.options.bloom_bits, 1e-9)))
        return writer

    def compact_until_stable(self) -> int:
        """Rounds done until no level is due."""
        done = 0
        while self.compact():
            done += 1
        return done

    def vacuum(self, lease: float | None = None) -> list[str]:
        """Delete run folders that neither the present version nor a pinned one names; their names.

        Pins of other stores on the folder count. What no manifest has named may belong to a commit that is under way, and goes once it is
        older than ``lease`` seconds (by default the option's).
        """
        self._open()
        if self.folder is None:
            return []
        lease, folder = self.options.lease if lease is None else lease, self.folder
        present = current(folder)
        keep = {present.version, self._manifest.version, *self._pinned, *(int(n.split("-")[0]) for n in folder.list("pins"))}
        old = {v: at_version(folder, v) for v in versions(folder) if v <= present.version}
        live = {r.path.split("/")[0] for v in keep & set(old) for r in old[v].runs}
        retired = {r.path.split("/")[0] for m in old.values() for r in m.runs} - live
        gone = [n for n in folder.list("runs") if n in retired or (n not in live and folder.age(f"runs/{n}") >= lease)]
        for name in gone:
            folder.delete(f"runs/{name}")
        for v in set(old) - keep:
            folder.delete(f"manifest/{v:020d}.json")
        for name in [*(f"staging/{n}" for n in folder.list("staging")), *(f"manifest/{n}" for n in folder.list("manifest") if n.endswith(".tmp"))]:
            if folder.age(name) >= lease:
                folder.delete(name)
        return gone

    def level_stats(self) -> DataFrame:
        return levels.scores(self.files(), self.options)

    def stats(self) -> dict[str, float]:
        """Counters, and write, read and space amplification."""
        m = self._manifest
        held = sum(r.file_size for r in m.runs)
        per = lambda a, b: a / b if b else 0.0
        return {
            **self.counters, "last_sequence": m.last_sequence, "version": m.version, "runs": len(m.runs), "bytes": held, "dropped_old": m.dropped_old, "dropped_tombstones": m.dropped_tombstones,
            "write_amp": per(m.flushed_bytes + m.compacted_bytes, m.user_bytes), "write_amp_flush": per(m.flushed_bytes, m.user_bytes), "read_amp": per(self.counters["runs_checked"], self.counters["gets"]), "space_amp": per(held, m.user_bytes),
        }

    @property
    def manifest(self) -> Manifest:
        return self._manifest


def _after(prefix):
    """The smallest key above all that start with ``prefix`` (str or bytes); None if there is none."""
    if isinstance(prefix, bytes):
        rest = prefix.rstrip(b"\xff")
        return rest[:-1] + bytes([rest[-1] + 1]) if rest else None
    rest = prefix.rstrip(chr(0x10FFFF))
    return rest[:-1] + chr(0xE000 if rest[-1] == chr(0xD7FF) else ord(rest[-1]) + 1) if rest else None


#: Rows that a cursor fetches at once, in the direction of its step.
PAGE = 256


class Cursor:
    """A position in the live rows of one snapshot, for a client that steps through some of them. Rows are fetched a page at a time.

    It stands before the first row, on a row (valid), or past the last one.
    """

    def __init__(self, store: Store, as_of: int):
        self._log, self._as_of, self._store = store.log(), as_of, store
        self._row, self._past = None, False
        self._page, self._at = [], 0  # neighbouring rows by key, and which of them the cursor stands on

    def _set(self, row, past: bool) -> None:
        self._row, self._past = row, past and row is None

    def _one(self, low=None, below=None, last: bool = False, above=None):
        """The first (or last) row of a range, as the end of a new page."""
        k = F.col(self._store.key)
        log = self._log if above is None else self._log.where(k > F.lit(above))
        found = views.range_scan(log, low, below, self._as_of, self._store.names)
        page = found.orderBy(F.desc(k) if last else k).select(*[f.name for f in self._store.schema.fields]).limit(PAGE).collect()
        self._page, self._at = (page[::-1], len(page) - 1) if last else (page, 0)
        return self._page[self._at] if page else None

    def _step(self, by: int):
        """The neighbour on the page, if it is there."""
        if not 0 <= self._at + by < len(self._page):
            return None
        self._at += by
        return self._page[self._at]

    @property
    def valid(self) -> bool:
        return self._row is not None

    def key(self):
        return self._row[0]

    def value(self) -> tuple:
        return tuple(self._row[1:])

    def seek_to_first(self) -> None:
        self._set(self._one(), past=True)

    def seek_to_last(self) -> None:
        self._set(self._one(last=True), past=False)

    def seek(self, target) -> None:
        self._set(self._one(low=target), past=True)

    def next(self) -> None:
        if self.valid:
            self._set(self._step(1) or self._one(above=self.key()), past=True)

    def prev(self) -> None:
        if self.valid:
            self._set(self._step(-1) or self._one(below=self.key(), last=True), past=False)
        elif self._past:
            self.seek_to_last()
