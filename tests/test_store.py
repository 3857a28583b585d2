"""The store against a dictionary, and its failures."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.errors import CommitConflict, Corruption, Frozen, InvalidArgument, NotFound
from tidemark.operators.batch import WriteBatch
from tidemark.options import Options
from tidemark.sources import manifest
from tidemark.sources.store import Store

SCHEMA = StructType([StructField("k", StringType()), StructField("v", StringType())])


def live(store, snapshot=None):
    return {r["k"]: r["v"] for r in store.scan(snapshot=snapshot).collect()}


@pytest.mark.parametrize("in_memory", [False, True])
def test_model(spark, tmp_path, in_memory):
    random.seed(11)
    store = Store.open(spark, None if in_memory else str(tmp_path / "db"), SCHEMA, Options(level0_trigger=2, max_file_size=2500 if not in_memory else 1 << 20))
    want, kept = {}, []
    for round_ in range(3):
        batch = WriteBatch()
        for i in range(40):
            k = f"k{random.randrange(25)}"
            if random.random() < 0.2:
                batch.delete(k)
                want.pop(k, None)
            else:
                batch.put(k, f"{round_}-{i}")
                want[k] = f"{round_}-{i}"
        last = store.write(batch)
        assert last == 40 * (round_ + 1)
        kept.append((store.snapshot(), dict(want)))
    assert store.compact_until_stable() >= 1
    assert live(store) == want
    for snapshot, then in kept:
        assert live(store, snapshot) == then
        store.release(snapshot)
    key = next(iter(want))
    assert store.get(key) == (want[key],)
    if not in_memory:
        store.vacuum()
        again = Store.open(spark, str(tmp_path / "db"), SCHEMA)
        assert live(again) == want and again.sync() == 120
    store.close()


def test_compaction_drops_what_no_snapshot_sees(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA, Options(level0_trigger=2))
    store.put("a", "1")
    held = store.snapshot()
    store.write(WriteBatch().put("a", "2").delete("b"))
    store.compact()
    assert live(store, held) == {"a": "1"} and live(store) == {"a": "2"}
    assert store.stats()["dropped_old"] == 0
    store.release(held)
    store.write(WriteBatch().put("a", "3"))
    store.compact(0)
    assert store.stats()["dropped_old"] == 2 and live(store) == {"a": "3"}


def test_a_writer_that_died_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    store = Store.open(spark, path, SCHEMA)
    store.put("a", "1")
    monkeypatch.setattr("tidemark.sources.store.publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.put("a", "2")
    monkeypatch.undo()
    again = Store.open(spark, path, SCHEMA)
    assert live(again) == {"a": "1"} and again.sync() == 1
    assert again.vacuum() == [] and len(again.vacuum(lease=0)) == 1 and len(again.folder.list("runs")) == 1
    again.put("a", "3")
    assert live(Store.open(spark, path, SCHEMA)) == {"a": "3"}


def test_opening_does_not_disturb_a_commit(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    store = Store.open(spark, path, SCHEMA)
    store.put("a", "1")
    whole = manifest.publish

    def publish(*a):
        other = Store.open(spark, path, SCHEMA)  # between the run and its publication
        assert live(other) == {"a": "1"} and other.vacuum() == []
        whole(*a)

    monkeypatch.setattr("tidemark.sources.store.publish", publish)
    store.put("b", "2")
    monkeypatch.undo()
    assert live(Store.open(spark, path, SCHEMA)) == {"a": "1", "b": "2"}


def test_two_publishes_at_once(spark, tmp_path):
    path = str(tmp_path / "db")
    folder = Store.open(spark, path, SCHEMA).folder
    base = manifest.current(folder)
    assert base.version == 0

    def publish(i):
        try:
            manifest.publish(folder, base, base.edit(set(), [], last_sequence=i))
            return i
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(publish, range(1, 9)) if x]
    assert len(won) == 1 and manifest.current(folder).last_sequence == won[0]
    assert not [n for n in folder.list("manifest") if n.endswith(".tmp")]


def test_a_commit_counts_from_the_rename_on(spark, tmp_path):
    """The writer dies before it swaps the pointer: the commit is there, and the next one builds on it."""
    path = str(tmp_path / "db")
    store = Store.open(spark, path, SCHEMA)
    store.put("a", "1")
    store.folder.swap("CURRENT", "0\n")
    again = Store.open(spark, path, SCHEMA)
    assert live(again) == {"a": "1"}
    again.put("b", "2")
    assert live(Store.open(spark, path, SCHEMA)) == {"a": "1", "b": "2"}


def test_pins_of_another_store(spark, tmp_path):
    path = str(tmp_path / "db")
    writer = Store.open(spark, path, SCHEMA)
    writer.put("a", "1")
    reader = Store.open(spark, path, SCHEMA)
    version, view = reader.pin(), reader.scan()
    writer.put("a", "2")
    writer.compact(0)
    assert len(writer.vacuum()) == 1  # of the second commit, which nobody pins
    assert [r["v"] for r in view.collect()] == ["1"]
    reader.unpin(version)
    assert len(writer.vacuum()) == 1


def test_commits_flush_by_themselves(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA, Options(write_buffer_size=600_000))
    for i in range(8):
        store.put("k", str(i))
    assert len([r for r in store.manifest.runs if r.level == 0]) < 8 and live(store) == {"k": "7"} and store.log().count() == 8


def test_one_write_makes_many_runs(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA, Options(level0_trigger=1, max_file_size=8192))
    rows = spark.range(4000).selectExpr("id AS ord", "1 AS t", "format_string('%06d', id) AS k", "repeat(uuid(), 3) AS v")
    store.write_frame(rows, ["ord"])
    store.compact(0)
    runs = [r for r in store.manifest.runs if r.level == 1]
    assert len(runs) > 3 and sum(r.n_entries for r in runs) == 4000 and len({r.path.split("/")[0] for r in runs}) == 1
    assert len(store.vacuum()) == 1 and Store.open(spark, str(tmp_path / "db"), SCHEMA).scan("000100", "000200").count() == 100


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "db")
    a, b = Store.open(spark, path, SCHEMA), Store.open(spark, path, SCHEMA)
    a.put("x", "1")
    with pytest.raises(CommitConflict):
        b.put("x", "2")
    assert live(Store.open(spark, path, SCHEMA)) == {"x": "1"}


def test_missing_run_is_corruption(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.put("a", "1")
    store.folder.delete(f"runs/{store.manifest.runs[0].path}")
    with pytest.raises(Corruption):
        Store.open(spark, str(tmp_path / "db"), SCHEMA)


def test_bad_pointer_is_corruption(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.put("a", "1")
    store.folder.write("CURRENT", "7", overwrite=True)
    with pytest.raises(Corruption):
        Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.folder.delete("CURRENT")
    with pytest.raises(Corruption):
        Store.open(spark, str(tmp_path / "db"), SCHEMA)


def test_arguments(spark):
    store = Store.open(spark, None, SCHEMA)
    for batch in (WriteBatch(), WriteBatch().put("", "x"), WriteBatch().put("k" * 65537, "x")):
        with pytest.raises(InvalidArgument):
            store.write(batch)
    assert store.sync() == 0
    with pytest.raises(InvalidArgument):
        store.get(None)
    with pytest.raises(NotFound):
        store.get("nothing")
    store.put("a", "")
    assert store.get("a") == ("",)
    store.delete("a")
    with pytest.raises(NotFound):
        store.get("a")
    store.close()
    store.close()
    with pytest.raises(Frozen):
        store.scan()
    with pytest.raises(InvalidArgument):
        Options(level_multiplier=1)


def test_cursor_states(spark):
    store = Store.open(spark, None, SCHEMA)
    empty = store.iterator()
    empty.seek_to_first()
    assert not empty.valid
    empty.seek_to_last()
    empty.prev()
    assert not empty.valid
    store.write(WriteBatch().put("a", "1").put("c", "3").delete("b"))
    c = store.iterator()
    c.prev()
    assert not c.valid
    c.seek_to_first()
    assert (c.key(), c.value()) == ("a", ("1",))
    c.next()
    assert c.key() == "c"
    c.next()
    c.next()
    assert not c.valid
    c.prev()
    assert c.key() == "c"
    c.seek("b")
    assert c.key() == "c"
    c.prev()
    c.prev()
    assert not c.valid
    c.prev()
    assert not c.valid


def test_a_view_stays_while_others_write(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.put("a", "1")
    version = store.pin()
    view = store.scan()
    store.put("a", "2")
    store.compact(0)
    store.vacuum()
    assert [r["v"] for r in view.collect()] == ["1"]
    store.unpin(version)
    assert len(store.vacuum()) == 1


def test_ranges_prune_runs(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.write(WriteBatch().put("a", "1").put("b", "1"))
    store.write(WriteBatch().put("x", "1").put("y", "1"))
    assert store.get("x") == ("1",)
    assert (store.counters["runs_checked"], store.counters["runs_skipped"]) == (1, 1)
    assert [r["k"] for r in store.scan("b", "y").orderBy("k").collect()] == ["b", "x"]
    assert [r["k"] for r in store.reverse(2).collect()] == ["y", "x"]


def test_replayed_micro_batches_do_nothing(spark):
    store = Store.open(spark, None, StructType([StructField("k", LongType()), StructField("v", LongType())]))
    rows = spark.createDataFrame([(0, 1, 5, 50), (1, 1, 6, 60)], "ord long, t int, k long, v long")
    assert store.write_frame(rows, ["ord"], ("s", 0)) == 2
    assert store.write_frame(rows, ["ord"], ("s", 0)) == 2
    assert store.write_frame(rows, ["ord"], ("s", 1)) == 4
    assert store.write_frame(rows.where("k > 9"), ["ord"], ("s", 2)) == 4
    assert store.manifest.batches == {"s": 2}


def test_batches(spark):
    b = WriteBatch().put("a", "A").put("b", "").delete("c").put("d", "x" * 9000)
    seen = []
    b.iterate(lambda k, v: seen.append((k, len(v))), lambda k: seen.append(k))
    assert seen == [("a", 1), ("b", 0), "c", ("d", 9000)] and len(b) == 4
    assert b.validate()[0] == 4 and b.byte_size() == 12 + b.validate()[1]
    b.clear()
    assert len(b) == 0 and b.byte_size() == 12


def test_flush_keeps_every_version(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.put("a", "1")
    held = store.snapshot()
    store.delete("a")
    store.put("b", "2")
    assert store.flush() and not store.flush()
    assert len(store.manifest.runs) == 1 and store.log().count() == 3
    assert live(store) == {"b": "2"} and live(store, held) == {"a": "1"}


def test_cursor_pages(spark, monkeypatch):
    from tidemark.sources import store as module

    monkeypatch.setattr(module, "PAGE", 3)
    store = Store.open(spark, None, SCHEMA)
    batch = WriteBatch()
    for i in range(11):
        batch.put(f"k{i:02d}", str(i))
    store.write(batch)
    c, seen = store.iterator(), []
    c.seek_to_first()
    while c.valid:
        seen.append(c.key())
        c.next()
    assert seen == [f"k{i:02d}" for i in range(11)]
    back = []
    c.prev()  # from past the end to the last row
    while c.valid:
        back.append(c.key())
        c.prev()
    assert back == seen[::-1]
    c.seek("k05")
    steps = []
    for go in (c.next, c.next, c.next, c.prev, c.prev, c.prev, c.prev, c.next):
        go()
        steps.append(c.key())
    assert steps == ["k06", "k07", "k08", "k07", "k06", "k05", "k04", "k05"]


def test_a_flipped_byte_is_found(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "db"), SCHEMA)
    store.put("key", "a value of some length, so that it is stored as it stands")
    store.verify()
    file = next((tmp_path / "db" / "runs").rglob("*.parquet"))
    raw = bytearray(file.read_bytes())
    raw[raw.index(b"of some") + 1] ^= 1
    file.write_bytes(bytes(raw))
    for beside in file.parent.glob(".*.crc"):  # the page's own checksum must do
        beside.unlink()
    spark.catalog.clearCache()
    with pytest.raises(Corruption):
        store.verify()


def test_a_full_store_in_memory_is_frozen(spark):
    store = Store.open(spark, None, SCHEMA, Options(write_buffer_size=100))
    store.put("a", "1")
    store.put("b", "2")
    with pytest.raises(Frozen):
        store.put("c", "3")
    assert live(store) == {"a": "1", "b": "2"}


def test_the_key_after_a_prefix():
    from tidemark.sources.store import _after

    top = chr(0x10FFFF)
    assert [_after(x) for x in ("ab", "a" + top, top, "", "a\ud7ff", b"a\xff", b"\xff\xff", b"a")] == ["ac", "b", None, None, "a\ue000", b"b", None, b"b"]
