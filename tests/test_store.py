"""The store through its public surface."""

import os
import random
import threading
from dataclasses import replace

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stratakv import Builder, Excluded, Included, SyncMode, errors, open_store
from stratakv.functions.keys import signed_bytes, unsigned_bytes
from stratakv.operators.compaction import TieredCompaction, committed
from stratakv.sources.manifest import Manifest, ManifestStore
from stratakv.sources.runs import KeyFilter
from stratakv.sources.wal import Log
from stratakv.streaming.ingest import ingest, rejected


def content(store, *bounds):
    return [(bytes(r["key"]), bytes(r["value"])) for r in store.scan(*bounds).collect()]


def frame(spark, rows):
    return spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "key binary, value binary")


def put(store, key, value):
    try:
        store.set(key, value)
    except errors.NeedFlush:
        store.flush_oldest_memtable()
        store.set(key, value)


def test_missing_directory(spark, tmp_path):
    with pytest.raises(errors.DataDirMissing):
        open_store(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_empty_store(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    assert content(store) == []
    assert store.get("x") is None
    store.compact()
    store.flush_oldest_memtable()
    assert (store.live_sstables(), store.metrics.compacts, store.metrics.sst_flushes) == (0, 0, 0)


def test_validation_and_metrics(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    for key, value, error in (("", "value", errors.KeyEmpty), ("key", "", errors.ValueEmpty), ("", "", errors.KeyEmpty), ("k" * 10_241, "", errors.KeyTooLarge), ("k", "v" * 102_401, errors.ValueTooLarge)):
        with pytest.raises(error):
            store.set(key, value)
    for bad, error in (("", errors.KeyEmpty), ("k" * 10_241, errors.KeyTooLarge)):
        with pytest.raises(error):
            store.get(bad)
        with pytest.raises(error):
            store.delete(bad)
    store.set("k" * 10_240, "v" * 102_400)
    store.delete("none")
    store.delete("none")
    assert store.get("none") is None
    assert store.get("k" * 10_240) == b"v" * 102_400
    store.shutdown()
    m = store.metrics
    assert (m.writes, m.deletes, m.reads) == (1, 2, 2)


def test_rollover_back_pressure_and_reopen(spark, tmp_path):
    store = Builder().wal_write_threshold(1000).open(spark, str(tmp_path))
    store.set("foo", "bar")
    store.delete("foo")
    for i in range(1, 2501):
        put(store, unsigned_bytes(i), unsigned_bytes(i * 2))
    assert (store.metrics.sst_flushes, store.metrics.writes, store.metrics.deletes) == (1, 2501, 1)
    assert store.get("foo") is None
    assert [store.get(unsigned_bytes(i)) for i in (1, 1500, 2500)] == [unsigned_bytes(i * 2) for i in (1, 1500, 2500)]
    want = [(unsigned_bytes(i), unsigned_bytes(i * 2)) for i in range(1, 2501)]
    assert content(store) == want
    again = Builder().wal_write_threshold(1000).open(spark, str(tmp_path))
    assert content(again) == want
    at = lambda lo, hi: len(content(again, Included(unsigned_bytes(lo)), hi))
    assert at(500, Included(unsigned_bytes(510))) == 11
    assert at(500, Excluded(unsigned_bytes(510))) == 10
    assert at(500, Included(unsigned_bytes(3000))) == 2001
    assert at(500, Excluded(unsigned_bytes(499))) == 0
    for i in range(2, 2501, 2):
        try:
            again.delete(unsigned_bytes(i))
        except errors.NeedFlush:
            again.flush_oldest_memtable()
            again.delete(unsigned_bytes(i))
    assert len(content(again)) == 1250


def test_need_flush_does_not_count(spark, tmp_path):
    store = Builder().wal_write_threshold(1).open(spark, str(tmp_path))
    store.set("a", "1")
    store.set("b", "2")
    with pytest.raises(errors.NeedFlush):
        store.set("c", "3")
    assert store.metrics.writes == 2
    store.flush_oldest_memtable()
    store.set("c", "3")
    assert content(store) == [(b"a", b"1"), (b"b", b"2"), (b"c", b"3")]


def test_buffer_fills_by_size(spark, tmp_path):
    store = Builder().target_sstable_size_bytes(1024).open(spark, str(tmp_path))
    store.set("a", "v" * 513)
    store.set("b", "v" * 513)
    assert not store.buffers.sealed
    store.set("c", "v" * 513)
    assert len(store.buffers.sealed) == 1
    store.set("c", "v" * 512)
    store.set("d", "v" * 513)
    with pytest.raises(errors.NeedFlush):
        store.set("e", "v")
    assert store.buffers.open.size_bytes == 513 + 514


def test_signed_scan(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(signed_bytes(i), b"v") for i in range(1, 2501)]))
    n = lambda i: len(content(store, Included(signed_bytes(i))))
    assert [n(i) for i in (500, 2499, -1400, 5000)] == [2001, 2, 2500, 0]
    assert store.scan(Included(b"\x00"), limit=1).first()["key"] == signed_bytes(1)
    assert content(store, Included(b"\xff")) == []


def test_bulk_and_single_writes_interleave(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.set("a", "single-old")
    store.put_many(frame(spark, [(b"a", b"bulk"), (b"b", b"bulk")]))
    assert content(store) == [(b"a", b"bulk"), (b"b", b"bulk")]
    store.set("a", "single-new")
    store.delete("b")
    assert content(store) == [(b"a", b"single-new")]
    store.delete_many(frame(spark, [(b"a", b"-")]).select("key"))
    store.set("b", "again")
    assert content(store) == [(b"b", b"again")]
    assert store.metrics.deletes == 2


def test_bulk_rejects(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    rows = frame(spark, [(b"ok", b"v"), (b"", b"v"), (b"big", b"v" * 102_401)])
    with pytest.raises((errors.KeyEmpty, errors.ValueTooLarge)):
        store.put_many(rows)
    assert content(store) == []
    bad = store.put_many(rows, on_reject="route")
    assert sorted(r["reason"] for r in bad.collect()) == ["KeyEmpty", "ValueTooLarge"]
    assert content(store) == [(b"ok", b"v")]


def test_last_sequence_number_of_a_batch_wins(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    df = spark.createDataFrame([(bytearray(b"k"), bytearray(str(i).encode()), i) for i in (3, 9, 1)], "key binary, value binary, seq long")
    store.put_many(df)
    assert store.get("k") == b"9"


def test_compaction_keeps_answers_and_drops_tombstones(spark, tmp_path):
    store = Builder().target_sstable_size_bytes(16 << 10).open(spark, str(tmp_path))
    n = 1000
    store.put_many(frame(spark, [(b"key_%06d" % i, b"old" * 10) for i in range(n)]))
    store.put_many(frame(spark, [(b"key_%06d" % i, b"new" * 10) for i in range(1, n, 4)]))
    store.delete_many(frame(spark, [(b"key_%06d" % i, b"-") for i in range(0, n, 2)]).select("key"))
    want = [(b"key_%06d" % i, (b"new" if i % 4 == 1 else b"old") * 10) for i in range(1, n, 2)]
    assert content(store) == want
    store.compact()
    m = store.manifests.load()
    assert m.l0 == ()
    assert m.l1[0].rows == len(want)
    assert content(store) == want
    assert content(store, Included(b"key_000250"), Excluded(b"key_000260")) == want[125:130]
    before = store.metrics.compacts
    store.compact()
    assert store.metrics.compacts == before == 1
    # The base's files do not overlap and are sorted.
    files = spark.read.parquet("file://" + os.path.join(store.root, "runs", m.l1[0].path)).groupBy(F.input_file_name().alias("f")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("lo").collect()
    assert len(files) > 1
    assert all(a["hi"] < b["lo"] for a, b in zip(files, files[1:], strict=False))
    assert content(open_store(spark, str(tmp_path))) == want
    assert store.vacuum()
    assert content(store) == want


def test_compaction_of_all_deleted(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    rows = frame(spark, [(b"a", b"1"), (b"b", b"2")])
    store.put_many(rows)
    store.delete_many(rows.select("key"))
    store.compact()
    assert store.live_sstables() == 0
    assert content(store) == []
    store.put_many(rows)
    assert len(content(store)) == 2


def test_runs_added_during_compaction_stay_newer(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"a", b"1"), (b"b", b"1")]))
    store.put_many(frame(spark, [(b"a", b"2")]))
    plan = store.policy.plan(store.manifests.load())
    from stratakv.operators.compaction import merge_runs

    output = merge_runs(spark, store.root, plan, 1 << 20)
    store.put_many(frame(spark, [(b"a", b"3")]))
    store.manifests.update(lambda m: committed(m, plan, output))
    assert content(store) == [(b"a", b"3"), (b"b", b"1")]
    assert len(store.manifests.load().l0) == 1
    with pytest.raises(errors.CompactionCommitFailure):
        store.manifests.update(lambda m: committed(m, plan, output))


def test_one_compaction_at_a_time(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store._compacting.acquire()
    with pytest.raises(errors.CompactionAlreadyRunning):
        store.compact()
    store._compacting.release()
    store.compact()


def test_manifest_is_compare_and_swap(tmp_path):
    a, b = ManifestStore(str(tmp_path)), ManifestStore(str(tmp_path))
    base = a.load()
    assert a.publish(base, replace(base, next_run_id=7)).version == 1
    assert b.publish(base, replace(base, next_run_id=9)) is None
    assert b.load().next_run_id == 7
    seen = []

    def bump(store):
        for _ in range(20):
            seen.append(store.update(lambda m: replace(m, next_run_id=m.next_run_id + 1)).version)

    threads = [threading.Thread(target=bump, args=(s,)) for s in (a, b)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert a.load() == Manifest(version=41, next_run_id=47)
    assert len(set(seen)) == 40


def test_snapshot_does_not_see_later_writes(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"a", b"1")]))
    store.set("b", "1")
    snapshot = store.scan()
    store.put_many(frame(spark, [(b"a", b"2"), (b"c", b"2")]))
    store.compact()
    assert [(bytes(r["key"]), bytes(r["value"])) for r in snapshot.collect()] == [(b"a", b"1"), (b"b", b"1")]


def test_log_replay(tmp_path):
    log = Log(str(tmp_path / "x.log"), True)
    log.append(b"k", b"v")
    log.append(b"k", None)
    assert Log(log.path, True).replay() == [(b"k", b"v"), (b"k", None)]
    whole = open(log.path, "rb").read()
    one = len(whole) - len(b"k") - 16  # the second record is a header and a key
    for cut in range(one + 1, len(whole)):
        open(log.path, "wb").write(whole[:cut])
        torn = Log(log.path, True)
        assert torn.replay() == [(b"k", b"v")]
        torn.append(b"z", b"1")
        assert Log(log.path, True).replay() == [(b"k", b"v"), (b"z", b"1")]
    open(log.path, "wb").write(whole[one:])
    with pytest.raises(errors.BadLogSeq):
        Log(log.path, True).replay()
    open(log.path, "wb").write(whole[: one - 1] + b"w" + whole[one:])
    with pytest.raises(errors.BadLogState):
        Log(log.path, True).replay()
    log.delete()
    with pytest.raises(errors.BadLogState):
        log.append(b"k", b"v")


def test_manual_sync(spark, tmp_path):
    store = Builder().wal_sync(SyncMode.MANUAL).open(spark, str(tmp_path))
    store.set("a", "1")
    store.wal_sync()
    assert open_store(spark, str(tmp_path)).get("a") == b"1"


def test_multi_get_prefix_and_view(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"app", b"1"), (b"apple", b"2"), (b"apq", b"3"), (b"\xff\xff", b"4")]))
    store.delete("apple")
    keys = spark.createDataFrame([(bytearray(b"app"),), (bytearray(b"apple"),), (bytearray(b"none"),)], "key binary")
    assert {bytes(r["key"]): r["value"] for r in store.multi_get(keys).collect()} == {b"app": bytearray(b"1"), b"apple": None, b"none": None}
    assert store.metrics.reads == 3
    assert [bytes(r["key"]) for r in store.scan_prefix("ap").collect()] == [b"app", b"apq"]
    assert [bytes(r["key"]) for r in store.scan_prefix(b"\xff").collect()] == [b"\xff\xff"]
    store.create_view("kv")
    assert spark.sql("SELECT count(*) AS n FROM kv").first()["n"] == 3


def wide(spark, n, value="v"):
    return spark.range(n).select(F.lpad(F.hex("id"), 16, "0").cast("binary").alias("key"), F.lit(value).cast("binary").alias("value"))


def files_read(df):
    """Files that the plan's scans have listed."""
    df.collect()
    return len(df.inputFiles())


def test_scans_name_the_files_of_their_range_only(spark, tmp_path):
    """A compacted base of many files: bounds leave out files on the driver, and reach the reader."""
    store = Builder().target_sstable_size_bytes(20_000).open(spark, str(tmp_path))
    store.put_many(wide(spark, 20_000))
    store.compact()
    files = store.live_sstables()
    assert files > 10
    one = store.scan(Included(b"0" * 16), Included(b"0" * 16))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan
    assert "GreaterThanOrEqual(key" in plan
    assert files_read(one) == 1
    assert files_read(store.scan()) == files
    assert 1 <= files_read(store.scan(Included(b"%016X" % 100), Excluded(b"%016X" % 300))) <= 3
    assert store.scan(Included(b"G")).count() == 0
    assert files_read(store.scan_prefix(b"00000000000000")) < files


def test_point_lookups_open_one_file_and_read_one_row_group(spark, tmp_path):
    store = Builder().target_sstable_size_bytes(20_000).open(spark, str(tmp_path))
    store.put_many(wide(spark, 20_000))
    store.compact()
    store.cache = type(store.cache)(store.root, largest=0)
    key = b"%016X" % 777
    assert store.get(key) == b"v"
    assert (store.cache.opened, store.cache.groups) == (1, 1)
    assert [store.get(b"%016X" % i) for i in (777, 778, 779)] == [b"v"] * 3
    assert (store.cache.opened, store.cache.groups) == (1, 1)
    # Keys between those of a file: nearly all are ruled out without a look at it.
    assert all(store.get(b"%016X" % i + b"x") is None for i in range(500))
    assert store.cache.ruled_out >= 450
    assert store.cache.opened <= 3


def test_key_filters():
    keys = [b"k%d" % i for i in range(5000)]
    made = KeyFilter.of(keys, len(keys))
    assert all(made.may_hold(k) for k in keys)
    assert sum(made.may_hold(b"x%d" % i) for i in range(5000)) < 150


@pytest.mark.parametrize("small", [True, False])
def test_a_flipped_byte_is_found(spark, tmp_path, small):
    store = open_store(spark, str(tmp_path))
    if small:
        for i in range(200):
            store.set(b"%04d" % i, b"value%d" % i)
        store.buffers.seal()
        store.flush_oldest_memtable()
    else:
        store.put_many(wide(spark, 200, "value"))
    run = store.manifests.load().l0[0]
    path = os.path.join(store.root, "runs", run.path)
    name = next(f for f in os.listdir(path) if f.startswith("part-"))
    column = pq.ParquetFile(os.path.join(path, name)).metadata.row_group(0).column(1)
    data = bytearray(open(os.path.join(path, name), "rb").read())
    first = column.dictionary_page_offset or column.data_page_offset
    data[first + column.total_compressed_size - 3] ^= 0xFF
    open(os.path.join(path, name), "wb").write(data)
    for f in os.listdir(path):
        if f.endswith(".crc"):
            os.unlink(os.path.join(path, f))
    again = open_store(spark, str(tmp_path))
    key = b"%04d" % 7 if small else b"%016X" % 7
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        again.get(key)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|Could not"):
        again.scan().collect()


def test_reads_and_writes_go_on_during_a_bulk_write(spark, tmp_path, monkeypatch):
    """The bulk write takes effect when it is published, over the single writes made meanwhile."""
    from stratakv.operators import store as module

    store = open_store(spark, str(tmp_path))
    store.set("a", "old")
    writing, go = threading.Event(), threading.Event()
    real = module.write_run

    def slow(*args):
        writing.set()
        assert go.wait(60)
        return real(*args)

    monkeypatch.setattr(module, "write_run", slow)
    bulk = threading.Thread(target=lambda: store.put_many(frame(spark, [(b"a", b"bulk"), (b"b", b"bulk")])))
    bulk.start()
    assert writing.wait(60)
    assert store.get("a") == b"old"
    store.set("a", "meanwhile")
    store.set("c", "meanwhile")
    assert store.get("a") == b"meanwhile"
    assert content(store) == [(b"a", b"meanwhile"), (b"c", b"meanwhile")]
    go.set()
    bulk.join()
    assert content(store) == [(b"a", b"bulk"), (b"b", b"bulk"), (b"c", b"meanwhile")]
    assert content(open_store(spark, str(tmp_path))) == content(store)


def test_repeated_keys_need_an_order(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    with pytest.raises(errors.DuplicateKey):
        store.put_many(frame(spark, [(b"a", b"1"), (b"b", b"1"), (b"a", b"2")]))
    assert content(store) == []
    store.put_many(frame(spark, [(b"a", b"1"), (b"b", b"1"), (b"a", b"2")]).withColumn("seq", F.expr("ascii(decode(value, 'UTF-8'))").cast("long")))
    assert content(store) == [(b"a", b"2"), (b"b", b"1")]


def test_batched_reads_count_once_computed(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"a", b"1")]))
    found = store.multi_get(frame(spark, [(b"a", b""), (b"b", b"")]).select("key"))
    assert store.metrics.reads == 0
    assert len(found.collect()) == 2
    assert store.metrics.reads == 2
    store.get("a")
    assert store.metrics.reads == 3


def test_tiers_are_merged_before_the_base(spark, tmp_path):
    store = Builder().compaction(TieredCompaction(width=3, share=1)).open(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"%05d" % i, b"base") for i in range(2000)]))
    store.policy = type(store.policy)(width=1)
    store.compact()
    store.policy = store.options.compaction
    base = store.manifests.load().l1
    model = {b"%05d" % i: b"base" for i in range(2000)}
    for step in range(7):
        rows = {b"%05d" % i: b"s%d" % step for i in range(step, 400, 7)}
        store.put_many(frame(spark, list(rows.items())))
        model |= rows
        store.delete_many(frame(spark, [(b"%05d" % (step * 3), b"-")]).select("key"))
        model.pop(b"%05d" % (step * 3), None)
        store.compact()
        m = store.manifests.load()
        assert [r.run_id for r in m.l0] == sorted((r.run_id for r in m.l0), reverse=True)
        assert content(store) == sorted(model.items())
        assert store.get(b"%05d" % (step * 3)) is None
    assert store.manifests.load().l1 == base
    assert len(store.manifests.load().l0) <= 4
    store.policy = TieredCompaction(width=1, share=1000)
    store.compact()
    assert store.manifests.load().l0 == ()
    assert content(store) == sorted(model.items())


def test_a_stream_keeps_what_it_rejects(spark, tmp_path):
    (tmp_path / "data").mkdir()
    store = open_store(spark, str(tmp_path / "data"))
    rows = frame(spark, [(b"a", b"1"), (b"", b"1"), (b"b", b""), (b"c", b"2")]).withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(1).cast("long"))
    rows.write.parquet(str(tmp_path / "in"))
    assert rejected(store, "s").count() == 0
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest(stream, store, "s", str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert content(store) == [(b"a", b"1"), (b"c", b"2")]
    assert sorted((bytes(r["key"]), r["reason"], r["batch_id"]) for r in rejected(store, "s").collect()) == [(b"", "KeyEmpty", 0), (b"b", "ValueEmpty", 0)]
    assert store.metrics.rejected == 2


def test_streaming_batches_are_taken_once(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    rows = frame(spark, [(b"a", b"1")]).withColumn("deleted", F.lit(False))
    store.apply_many(rows, query="q", batch_id=0)
    store.apply_many(rows, query="q", batch_id=0)
    assert len(store.manifests.load().l0) == 1
    store.apply_many(rows, query="q", batch_id=1)
    assert len(store.manifests.load().l0) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_model(spark, tmp_path, seed):
    """Random sets, deletes, bulk writes, flushes, compactions and reopens against a dict."""
    rng, model = random.Random(seed), {}
    options = Builder().wal_write_threshold(15).target_sstable_size_bytes(2000)
    store = options.open(spark, str(tmp_path))
    for step in range(40):
        kind = rng.choice(["set"] * 12 + ["delete"] * 5 + ["bulk", "bulk_delete", "flush", "compact", "reopen", "check"])
        keys = [b"k%02d" % rng.randrange(40) for _ in range(8)]
        if kind in ("set", "delete"):
            for k in keys:
                v = b"%d-%d" % (step, rng.randrange(99))
                try:
                    store.set(k, v) if kind == "set" else store.delete(k)
                except errors.NeedFlush:
                    store.flush_oldest_memtable()
                    store.set(k, v) if kind == "set" else store.delete(k)
                model[k] = v if kind == "set" else None
        elif kind == "bulk":
            rows = {k: b"bulk%d" % step for k in keys}
            store.put_many(frame(spark, list(rows.items())))
            model |= rows
        elif kind == "bulk_delete":
            store.delete_many(frame(spark, [(k, b"-") for k in set(keys)]).select("key"))
            model |= dict.fromkeys(keys)
        elif kind == "flush":
            store.flush_oldest_memtable()
        elif kind == "compact":
            store.compact()
        elif kind == "reopen":
            store = options.open(spark, str(tmp_path))
        else:
            lo, hi = sorted(keys[:2])
            want = sorted((k, v) for k, v in model.items() if v is not None and lo <= k < hi)
            assert content(store, Included(lo), Excluded(hi)) == want
    assert content(store) == sorted((k, v) for k, v in model.items() if v is not None)
    assert all(store.get(k) == model.get(k) for k in (b"k00", b"k07", b"k39"))


def test_point_lookups_in_cached_and_large_runs(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"%04d" % i, b"old%d" % i) for i in range(500)]))
    store.put_many(frame(spark, [(b"%04d" % i, b"new") for i in range(0, 500, 5)]))
    store.delete_many(frame(spark, [(b"%04d" % i, b"-") for i in range(0, 500, 25)]).select("key"))
    want = {b"%04d" % i: None if i % 25 == 0 else b"new" if i % 5 == 0 else b"old%d" % i for i in range(500)}
    for limits in ({}, {"largest": 0}, {"limit": 1}):
        store.cache = type(store.cache)(store.root, **limits)
        assert all(store.get(k) == want[k] for k in list(want)[:60])
        assert store.get(b"none") is None
        assert store.cache.held <= store.cache.limit


def test_a_compacted_store_is_read_without_a_search_for_the_newest(spark, tmp_path):
    store = open_store(spark, str(tmp_path))
    store.put_many(frame(spark, [(b"%03d" % i, b"1") for i in range(300)]))
    store.put_many(frame(spark, [(b"%03d" % i, b"2") for i in range(0, 300, 3)]))
    plan = lambda: store.scan()._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan()
    store.compact()
    assert "Window" not in plan()
    assert plan().count("Exchange") == 1
    # A small run over the base: its keys are broadcast, the base stays where it is but for the order.
    store.delete_many(frame(spark, [(b"007", b"-")]).select("key"))
    store.set("008", "3")
    assert "BroadcastHashJoin" in plan()
    got = dict(content(store))
    assert (b"007" in got, got[b"008"], got[b"009"], len(got)) == (False, b"3", b"2", 299)
