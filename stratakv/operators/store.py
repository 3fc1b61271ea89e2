"""The store: single and bulk writes, point and batched lookups, ordered range scans, compaction."""

from __future__ import annotations

import enum
import os
import shutil
import threading
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import errors
from ..functions.keys import successor
from ..functions.validate import check_key, check_value, split, strict
from ..plans import resolve
from ..plans.bounds import UNBOUNDED, Bound, Excluded, Included, restrict
from ..plans.sizing import files_for
from ..schema import local_oplog
from ..sources.manifest import Manifest, ManifestStore
from ..sources.runs import RunCache, Written, read_runs, write_run, write_small_run
from .buffers import Buffer, Buffers
from .compaction import CompactionPolicy, FullCompaction, committed, merge_runs


class SyncMode(enum.Enum):
    """FULL: a single write is on disk when it returns. MANUAL: when wal_sync() returns."""

    FULL = "full"
    MANUAL = "manual"


@dataclass(frozen=True)
class Options:
    wal_sync: SyncMode = SyncMode.FULL
    #: The public defaults.
    wal_write_threshold: int = 250_000
    target_sstable_size_bytes: int = 256 << 20
    compaction: CompactionPolicy = FullCompaction()


@dataclass
class Metrics:
    """Counts of what this handle has done."""

    sst_flushes: int = 0
    point_reads: int = 0
    writes: int = 0
    deletes: int = 0
    compacts: int = 0
    rejected: int = 0
    lazy_reads: list[Observation] = field(default_factory=list)

    @property
    def reads(self) -> int:
        """Keys asked for, of batched lookups those whose result has been computed."""
        waiting = []
        for seen in self.lazy_reads:
            if seen._jo.future().isCompleted():
                self.point_reads += seen.get["n"]
            else:
                waiting.append(seen)
        self.lazy_reads[:] = waiting
        return self.point_reads


class Builder:
    """Options, then open()."""

    def __init__(self):
        self.options = Options()

    def wal_sync(self, mode: SyncMode) -> Builder:
        self.options = replace(self.options, wal_sync=mode)
        return self

    def wal_write_threshold(self, n: int) -> Builder:
        self.options = replace(self.options, wal_write_threshold=n)
        return self

    def target_sstable_size_bytes(self, n: int) -> Builder:
        self.options = replace(self.options, target_sstable_size_bytes=n)
        return self

    def compaction(self, policy: CompactionPolicy) -> Builder:
        self.options = replace(self.options, compaction=policy)
        return self

    def open(self, spark: SparkSession, path: str) -> KVStore:
        return KVStore(spark, path, self.options)


def open_store(spark: SparkSession, path: str) -> KVStore:
    """Open with default options."""
    return Builder().open(spark, path)


def _bytes(x: bytes | bytearray | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class KVStore:
    """One keyspace in one directory that driver and executors share.

    Single writes go to a buffer on the driver, with a log; bulk writes become a run at once. One
    handle writes at a time; any number of handles and sessions may read, each from a snapshot.
    """

    def __init__(self, spark: SparkSession, path: str, options: Options):
        if not os.path.isdir(path):
            raise errors.DataDirMissing(path)
        self.spark, self.root, self.options = spark, os.path.abspath(path), options
        self.manifests = ManifestStore(self.root)
        self.buffers = Buffers(os.path.join(self.root, "wal"), options.wal_sync is SyncMode.FULL)
        self.cache = RunCache(self.root)
        self.metrics = Metrics()
        self.policy = options.compaction
        self._compacting = threading.Lock()
        #: Held while a bulk write's files are not published yet; _state for moments only.
        self._bulk = threading.Lock()
        self._state = threading.RLock()

    # -- single writes and reads --------------------------------------------------------------

    def _room(self) -> Buffer:
        """The buffer for the next write. A full one is sealed; while one waits sealed, a full one is NeedFlush."""
        now = self.buffers.open
        if now.writes < self.options.wal_write_threshold and now.size_bytes <= self.options.target_sstable_size_bytes:
            return now
        if self.buffers.sealed:
            raise errors.NeedFlush
        self.buffers.seal()
        return self.buffers.open

    def set(self, key: bytes | str, value: bytes | str) -> None:
        key, value = _bytes(key), _bytes(value)
        check_key(key)
        check_value(value)
        with self._state:
            self._room().put(key, value)
            self.metrics.writes += 1

    def delete(self, key: bytes | str) -> None:
        """Deleting a key that is not there is fine."""
        key = _bytes(key)
        check_key(key)
        with self._state:
            self._room().put(key, None)
            self.metrics.deletes += 1

    def get(self, key: bytes | str) -> bytes | None:
        """The newest record of the key, from buffers, then runs from new to old.

        Works on the driver, one key at a time; for many keys use multi_get().
        """
        key = _bytes(key)
        check_key(key)
        with self._state:
            known, value = self.buffers.find(key)
            manifest = self.manifests.load()
            for run in manifest.runs if not known else ():
                known, value = self.cache.find(run, key)
                if known:
                    break
        self.metrics.point_reads += 1
        return value

    def wal_sync(self) -> None:
        with self._state:
            self.buffers.sync_logs()

    def shutdown(self) -> None:
        """Nothing to do: all that was acknowledged can be read again."""

    # -- bulk writes --------------------------------------------------------------------------

    def put_many(self, rows: DataFrame, on_reject: str = "raise", query: str | None = None, batch_id: int | None = None) -> DataFrame | None:
        """Store (key, value[, seq]). See apply_many()."""
        return self.apply_many(rows.withColumn("deleted", F.lit(False)), on_reject, query, batch_id)

    def delete_many(self, keys: DataFrame, on_reject: str = "raise") -> DataFrame | None:
        """Delete each key of (key[, seq])."""
        return self.apply_many(keys.withColumn("value", F.lit(None).cast("binary")).withColumn("deleted", F.lit(True)), on_reject)

    def apply_many(self, writes: DataFrame, on_reject: str = "raise", query: str | None = None, batch_id: int | None = None) -> DataFrame | None:
        """Store (key, value, deleted[, seq]) as one run, published at once or not at all.

        Of several writes of a key the highest seq wins; without seq a key may occur once only, for rows
        of a DataFrame have no order. on_reject: 'raise' fails the batch if a write breaks a size rule;
        'route' stores the others and returns those with a column reason. With query and batch_id a batch
        that was taken already is left.

        Reads and single writes go on while files are written. The batch takes effect when its run is
        published: it is newer than all single writes that came before that moment.
        """
        if query is not None and self.manifests.load().batches.get(query, -1) >= batch_id:
            return None
        rows = writes.withColumn("key", F.col("key").cast("binary")).withColumn("value", F.when(~F.col("deleted"), F.col("value").cast("binary")))
        ordered = "seq" in writes.columns
        if not ordered:
            rows = rows.withColumn("seq", F.lit(0).cast("long"))
        rows = rows.select("key", "value", "deleted", "seq")
        if on_reject == "route":
            good, bad = split(rows)
        else:
            good, bad = strict(rows), None
        counts = Observation()
        good = good.observe(counts, F.count(F.when(~F.col("deleted"), 1)).alias("w"), F.count(F.when(F.col("deleted"), 1)).alias("d"))
        try:
            newest = resolve.latest(good, "seq") if ordered else resolve.single(good, errors.DuplicateKey.__name__)
            with self._bulk:
                written = write_run(newest, self.root, "run", self._files_of(good))
                with self._state:
                    self._drain()
                    self._add_run(written, query, batch_id)
                    self.metrics.writes += counts.get["w"]
                    self.metrics.deletes += counts.get["d"]
        except Exception as e:
            reason = next((r for r in errors.BY_REASON if f"rejected write: {r}" in str(e)), None)
            raise (errors.BY_REASON[reason]() if reason else e) from e
        return bad

    def _files_of(self, rows: DataFrame) -> int:
        """Files for rows: one if the planner's estimate is far below the target, else by their size."""
        target = self.options.target_sstable_size_bytes
        if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * 8 <= target:
            return 1
        total = rows.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0]
        return files_for(total or 0, target)

    # -- what a read sees ---------------------------------------------------------------------

    def _layers(self, lower: Bound, upper: Bound) -> tuple[DataFrame | None, bool, DataFrame | None]:
        """What is above the base, whether its keys are unique, and the base; None for no rows."""
        with self._state:
            manifest, tables = self.manifests.load(), list(self.buffers.filled())
            local = [local_oplog(self.spark, t.rows).withColumn("run_id", F.lit(manifest.next_run_id + age).cast("long")) for age, t in enumerate(tables)]
        parts = [read_runs(self.spark, self.root, manifest.l0, lower, upper)] if manifest.l0 else []
        parts += [restrict(rows, lower, upper) for rows in local]
        base = read_runs(self.spark, self.root, manifest.l1, lower, upper) if manifest.l1 else None
        return resolve.merge(parts) if parts else None, len(manifest.l0) + len(tables) <= 1, base

    def records(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
        """All versions of the range: (key, value, deleted, seq, run_id), buffers newest."""
        top, _, base = self._layers(lower, upper)
        parts = [p for p in (top, base) if p is not None]
        return resolve.merge(parts) if parts else read_runs(self.spark, self.root, ())

    def _visible(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, keys: DataFrame | None = None) -> DataFrame:
        """(key, value) as of now. One run alone needs no search for the newest, nor does the base."""
        top, unique, base = self._layers(lower, upper)
        if keys is not None:
            top, base = (None if p is None else resolve.named(p, keys) for p in (top, base))
        if top is None and base is None:
            rows = read_runs(self.spark, self.root, ())
        elif top is None:
            rows = base
        else:
            rows = top if unique else resolve.latest(top)
            rows = rows if base is None else resolve.over_base(rows, base)
        return resolve.visible(rows).select("key", "value")

    # -- reads --------------------------------------------------------------------------------

    def scan(self, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, limit: int | None = None) -> DataFrame:
        """(key, value) of the range in key order, as of now; pull rows with toLocalIterator()."""
        rows = self._visible(lower, upper).orderBy("key")
        return rows if limit is None else rows.limit(limit)

    def scan_prefix(self, prefix: bytes | str) -> DataFrame:
        prefix = _bytes(prefix)
        end = successor(prefix)
        return self.scan(Included(prefix), Excluded(end) if end is not None else UNBOUNDED)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """(key, value) for each row of keys; null for keys that are missing or deleted.

        They count as reads once the result has been computed.
        """
        seen = Observation()
        found = keys.select("key").join(self._visible(keys=keys), "key", "left").observe(seen, F.count("*").alias("n"))
        self.metrics.lazy_reads.append(seen)
        return found

    def create_view(self, name: str) -> None:
        """A temporary SQL view of what a full scan sees now."""
        self._visible().createOrReplaceTempView(name)

    def live_sstables(self) -> int:
        """Run files in use."""
        m = self.manifests.load()
        return sum(r.files for r in m.runs)

    # -- maintenance --------------------------------------------------------------------------

    def flush_oldest_memtable(self) -> None:
        """Make a run of the sealed buffer, if there is one. Call it when a write raises NeedFlush."""
        with self._state:
            if self.buffers.sealed:
                self._flush(self.buffers.sealed[0])
                self.metrics.sst_flushes += 1

    def compact(self) -> None:
        """Merge the runs that the policy names, by default all into the base. Scans and writes go on meanwhile."""
        if not self._compacting.acquire(blocking=False):
            raise errors.CompactionAlreadyRunning
        try:
            plan = self.policy.plan(self.manifests.load())
            if plan is None:
                return
            output = merge_runs(self.spark, self.root, plan, self.options.target_sstable_size_bytes)
            self.manifests.update(lambda m: committed(m, plan, output))
            self.metrics.compacts += 1
        finally:
            self._compacting.release()

    def vacuum(self) -> list[str]:
        """Remove run files that the current manifest does not name. Nothing else may be reading old ones.

        Waits for bulk writes and compactions of this handle, whose files are not in a manifest yet.
        """
        with self._compacting, self._bulk, self._state:
            live = {r.path for r in self.manifests.load().runs}
            runs = os.path.join(self.root, "runs")
            gone = [n for n in (os.listdir(runs) if os.path.isdir(runs) else []) if n not in live]
            for n in gone:
                shutil.rmtree(os.path.join(runs, n))
        return gone

    def _flush(self, buffer: Buffer) -> None:
        if len(buffer):
            done = write_small_run(buffer.rows, self.root)
            self.cache.add(done.path, done.bytes, buffer.rows)
            self._add_run(done)
        # A crash before this line replays records that the run holds already: the same values.
        self.buffers.retire(buffer)

    def _add_run(self, written: Written | None, query: str | None = None, batch_id: int | None = None) -> None:
        def change(m: Manifest) -> Manifest:
            batches = m.batches if query is None else {**m.batches, query: batch_id}
            if written is None:
                return replace(m, batches=batches)
            return replace(m, next_run_id=m.next_run_id + 1, l0=(written.named(m.next_run_id), *m.l0), batches=batches)

        if written is not None or query is not None:
            self.manifests.update(change)

    def _drain(self) -> None:
        """Make runs of all buffers, oldest first, so that a bulk write is newer than they are."""
        if len(self.buffers.open):
            self.buffers.seal()
        for buffer in self.buffers.sealed:
            self._flush(buffer)
