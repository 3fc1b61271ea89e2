"""Registered queries of the key-value engine over the driver's tables, and their DuckDB SQL.

The op-log: each event writes its user's key (8 bytes, big-endian) with its props as the value; an
error event deletes the key. event_id is the sequence number, and runs are four bands of event_id,
the highest the newest. Keys leave as lower-case hex.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .errors import NeedFlush
from .functions.keys import composite_key, key_hex, signed_key, unsigned_bytes, unsigned_key
from .functions.validate import reject_reason
from .operators.compaction import TieredCompaction
from .operators.store import Builder
from .plans import resolve
from .plans.bounds import UNBOUNDED, Bound, Excluded, Included

Query = Callable[[SparkSession, str], DataFrame]
RUNS = 4


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    top = events.agg(F.max("event_id")).scalar()
    return events.select(
        unsigned_key(F.col("user_id")).alias("key"),
        F.when(F.col("event_type") != "error", F.col("props").cast("binary")).alias("value"),
        (F.col("event_type") == "error").alias("deleted"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") * RUNS / (top + 1)).cast("long").alias("run_id"),
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(key_hex(F.col("key")).alias("key_hex"), F.col("value").cast("string").alias("value"))


OPLOG_SQL = f"""
log AS (
  SELECT user_id, printf('%016x', user_id) AS key_hex, CASE WHEN event_type <> 'error' THEN props END AS value,
    event_type = 'error' AS deleted, event_id AS seq,
    floor(event_id * {RUNS}.0 / ((SELECT max(event_id) FROM events) + 1))::BIGINT AS run_id
  FROM events
), newest AS (
  SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY key_hex ORDER BY run_id DESC, seq DESC) AS nth FROM log) WHERE nth = 1
), live AS (
  SELECT user_id, key_hex, value FROM newest WHERE NOT deleted
)"""


def _sql(body: str) -> str:
    return f"WITH {OPLOG_SQL.strip()}\n{body}"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name], SQL[name] = query, sql
        return query

    return add


def _range(name: str, lower: Bound, upper: Bound, test: str) -> None:
    @_register(name, _sql(f"SELECT key_hex, value FROM live WHERE {test} ORDER BY key_hex"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _shown(resolve.scan(oplog(spark, sf_dir), lower, upper))


_k = unsigned_bytes
_range("scan_all", UNBOUNDED, UNBOUNDED, "true")
_range("scan_incl_incl", Included(_k(3)), Included(_k(90)), "user_id >= 3 AND user_id <= 90")
_range("scan_incl_excl", Included(_k(3)), Excluded(_k(90)), "user_id >= 3 AND user_id < 90")
_range("scan_excl_incl", Excluded(_k(3)), Included(_k(90)), "user_id > 3 AND user_id <= 90")
_range("scan_excl_excl", Excluded(_k(3)), Excluded(_k(90)), "user_id > 3 AND user_id < 90")
_range("scan_lower_only", Included(_k(40)), UNBOUNDED, "user_id >= 40")
_range("scan_lower_excl_only", Excluded(_k(40)), UNBOUNDED, "user_id > 40")
_range("scan_upper_only", UNBOUNDED, Included(_k(40)), "user_id <= 40")
_range("scan_upper_excl_only", UNBOUNDED, Excluded(_k(40)), "user_id < 40")
_range("scan_single_key", Included(_k(7)), Included(_k(7)), "user_id = 7")
_range("scan_beyond_max", Included(_k(20)), Included(_k(10**9)), "user_id >= 20")
_range("scan_empty_lower", Included(b""), Included(_k(60)), "user_id <= 60")


@_register("scan_inverted_bounds", _sql("SELECT count(*) AS n_rows FROM live WHERE user_id >= 50 AND user_id < 49"))
def scan_inverted_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(oplog(spark, sf_dir), Included(_k(50)), Excluded(_k(49))).agg(F.count("*").alias("n_rows"))


@_register("scan_equal_bounds_excl", _sql("SELECT count(*) AS n_rows FROM live WHERE user_id >= 7 AND user_id < 7"))
def scan_equal_bounds_excl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.scan(oplog(spark, sf_dir), Included(_k(7)), Excluded(_k(7))).agg(F.count("*").alias("n_rows"))


@_register("scan_first_n", _sql("SELECT key_hex, value FROM live ORDER BY key_hex LIMIT 25"))
def scan_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(resolve.scan(oplog(spark, sf_dir), limit=25))


@_register("scan_descending", _sql("SELECT key_hex, value FROM live ORDER BY key_hex DESC LIMIT 25"))
def scan_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(resolve.visible(resolve.latest(oplog(spark, sf_dir))).orderBy(F.desc("key")).limit(25))


@_register("scan_count", _sql("SELECT count(*) AS n_rows FROM live"))
def scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.visible(resolve.latest(oplog(spark, sf_dir))).agg(F.count("*").alias("n_rows"))


def _get(name: str, user: str, user_of: Callable[[SparkSession, str], DataFrame]) -> None:
    @_register(name, _sql(f"SELECT printf('%016x', q.user_id) AS key_hex, live.value FROM (SELECT ({user})::BIGINT AS user_id) q LEFT JOIN live ON live.user_id = q.user_id"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        keys = user_of(spark, sf_dir).select(unsigned_key(F.col("user_id")).alias("key"))
        return _shown(resolve.multi_get(oplog(spark, sf_dir), keys))


def _state_user(deleted: bool) -> Callable[[SparkSession, str], DataFrame]:
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        newest = resolve.latest(oplog(spark, sf_dir)).where(F.col("deleted") == deleted)
        return newest.agg(F.conv(F.hex(F.min("key")), 16, 10).cast("long").alias("user_id"))

    return of


_get("get_present", "SELECT min(user_id) FROM live", _state_user(False))
_get("get_deleted", "SELECT min(user_id) FROM newest WHERE deleted", _state_user(True))
_get("get_missing", "SELECT max(user_id) + 1000 FROM events", lambda s, d: _table(s, d, "events").agg((F.max("user_id") + 1000).alias("user_id")))


@_register("multi_get", _sql("SELECT printf('%016x', c.c_custkey) AS key_hex, live.value FROM customer c LEFT JOIN live ON live.user_id = c.c_custkey"))
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(unsigned_key(F.col("c_custkey")).alias("key"))
    return _shown(resolve.multi_get(oplog(spark, sf_dir), keys))


def _versions(rows: DataFrame) -> DataFrame:
    return rows.select(key_hex(F.col("key")).alias("key_hex"), F.col("value").cast("string").alias("value"), "deleted", "seq", "run_id")


@_register("latest_with_tombstones", _sql("SELECT key_hex, value, deleted, seq, run_id FROM newest"))
def latest_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(resolve.latest(oplog(spark, sf_dir)))


@_register("l0_flush_dedup", _sql("SELECT key_hex, value, deleted, seq, run_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key_hex ORDER BY seq DESC) AS nth FROM log) WHERE nth = 1"))
def l0_flush_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each run holds after its flush: the newest record of each key, tombstones kept."""
    return _versions(resolve.latest_in_runs(oplog(spark, sf_dir)))


@_register("layered_merge_4_runs", _sql("SELECT key_hex, value FROM live"))
def layered_merge_4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(resolve.scan(resolve.latest_in_runs(oplog(spark, sf_dir))))


@_register("orders_overlay", """
WITH base AS (SELECT o_orderkey AS id, o_orderstatus AS value, 0 AS run, 0 AS seq, false AS deleted FROM orders),
over AS (SELECT event_id AS id, event_type AS value, 1 AS run, event_id AS seq, event_type = 'error' AS deleted FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY run DESC, seq DESC) AS nth FROM (SELECT * FROM base UNION ALL SELECT * FROM over))
SELECT printf('%016x', id) AS key_hex, value FROM r WHERE nth = 1 AND NOT deleted""")
def orders_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A large base run with a newer run of sets and deletes over it."""
    base = _table(spark, sf_dir, "orders").select(unsigned_key(F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").cast("binary").alias("value"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("run_id"))
    gone = F.col("event_type") == "error"
    over = _table(spark, sf_dir, "events").select(unsigned_key(F.col("event_id")).alias("key"), F.when(~gone, F.col("event_type").cast("binary")).alias("value"), gone.alias("deleted"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("run_id"))
    return _shown(resolve.scan(resolve.merge([base, over])))


@_register("set_then_delete", "SELECT count(*) AS n_rows FROM orders WHERE o_orderkey % 2 = 1")
def set_then_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders are set; those with even keys are deleted in a newer run."""
    sets, deletes = _sets_deletes(spark, sf_dir)
    rows = resolve.merge([sets.withColumn("run_id", F.lit(0).cast("long")), deletes.withColumn("run_id", F.lit(1).cast("long"))])
    return resolve.visible(resolve.latest(rows)).agg(F.count("*").alias("n_rows"))


@_register("delete_then_set", "SELECT count(*) AS n_rows FROM orders")
def delete_then_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of keys that are not there, then sets of all: every key is back."""
    sets, deletes = _sets_deletes(spark, sf_dir)
    rows = resolve.merge([sets.withColumn("run_id", F.lit(1).cast("long")), deletes.withColumn("run_id", F.lit(0).cast("long"))])
    return resolve.visible(resolve.latest(rows)).agg(F.count("*").alias("n_rows"))


def _sets_deletes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders")
    key = unsigned_key(F.col("o_orderkey")).alias("key")
    seq = F.col("o_orderkey").alias("seq")
    sets = orders.select(key, F.col("o_orderpriority").cast("binary").alias("value"), F.lit(False).alias("deleted"), seq)
    deletes = orders.where("o_orderkey % 2 = 0").select(key, F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted"), seq)
    return sets, deletes


@_register("run_key_ranges", _sql("SELECT run_id, min(key_hex) AS min_key_hex, max(key_hex) AS max_key_hex, count(*) AS n_records FROM log GROUP BY run_id"))
def run_key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve.key_ranges(oplog(spark, sf_dir))
    return r.select("run_id", key_hex(F.col("min_key")).alias("min_key_hex"), key_hex(F.col("max_key")).alias("max_key_hex"), "n_records")


@_register("memtable_size_estimate", _sql("SELECT sum(8 + CASE WHEN value IS NULL THEN 0 ELSE octet_length(encode(value)) END)::BIGINT AS size_bytes, count(*) AS n_keys FROM newest"))
def memtable_size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.size_estimate(oplog(spark, sf_dir))


@_register("wal_seq_gaps", _sql("SELECT run_id, count(*) AS n_records, min(seq) AS first_seq, coalesce(sum(CASE WHEN step <> 1 THEN 1 ELSE 0 END), 0)::BIGINT AS n_gaps FROM (SELECT run_id, seq, seq - lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS step FROM log WHERE seq % 10 <> 3) GROUP BY run_id"))
def wal_seq_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a log from which records are missing (those whose number ends in 3)."""
    return resolve.sequence_gaps(oplog(spark, sf_dir).where("seq % 10 <> 3"))


#: Writes that break each size rule, planted by the remainder of doc_id.
_PLANTED_SQL = """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN '' WHEN 2 THEN repeat('k', 10241) ELSE printf('%016x', doc_id) END AS k,
  CASE doc_id % 10 WHEN 1 THEN '' WHEN 3 THEN repeat('v', 102401) WHEN 0 THEN '' ELSE coalesce(text, '') END AS v, doc_id % 10 = 4 AS deleted FROM documents"""


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("doc_id") % 10
    key = F.when(by == 0, F.lit("")).when(by == 2, F.repeat(F.lit("k"), 10_241)).otherwise(F.lower(F.lpad(F.hex("doc_id"), 16, "0")))
    value = F.when(by.isin(0, 1), F.lit("")).when(by == 3, F.repeat(F.lit("v"), 102_401)).otherwise(F.coalesce("text", F.lit("")))
    return _table(spark, sf_dir, "documents").select("doc_id", key.cast("binary").alias("key"), value.cast("binary").alias("value"), (by == 4).alias("deleted"))


_REASON_SQL = f"""SELECT CASE WHEN octet_length(encode(k)) = 0 THEN 'KeyEmpty' WHEN octet_length(encode(k)) > 10240 THEN 'KeyTooLarge' WHEN deleted THEN 'accepted'
  WHEN octet_length(encode(v)) = 0 THEN 'ValueEmpty' WHEN octet_length(encode(v)) > 102400 THEN 'ValueTooLarge' ELSE 'accepted' END AS reason, count(*) AS n_rows FROM ({_PLANTED_SQL}) GROUP BY 1"""


@_register("validate_documents", _REASON_SQL)
def validate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size rules on documents as writes; every rule is broken by some."""
    reason = reject_reason(F.col("key"), F.col("value"), F.col("deleted"))
    return _planted(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n_rows"))


@_register("signed_key_order", "SELECT c_custkey - 700 AS id, printf('%016x', xor((c_custkey - 700)::BIGINT, -9223372036854775807 - 1)) AS key_hex, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer")
def signed_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of signed integers order as the integers do."""
    ids = _table(spark, sf_dir, "customer").select((F.col("c_custkey") - 700).cast("long").alias("id")).withColumn("key", signed_key(F.col("id")))
    return _nth(ids, "key").select("id", key_hex(F.col("key")).alias("key_hex"), "nth")


def _nth(rows: DataFrame, *by: str) -> DataFrame:
    """Rank of each row in one global order, nulls last: sorted partitions, then the partitions' offsets.

    The partitioning is written out once, for its ranges come from a sample and both uses must see the same.
    """
    spark = rows.sparkSession
    order = [F.col(c).asc_nulls_last() for c in by]
    path = "file://" + os.path.join(scratch_dir(spark), "ranges")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    inside = spark.read.parquet(path).withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = inside.groupBy("_part").agg(F.max("_in").alias("_n"))
    # One row a partition.
    starts = counts.select("_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    return inside.join(F.broadcast(starts), "_part").withColumn("nth", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


@_register("byte_order_urls", "SELECT page_id, hex(encode(url)) AS url_hex, row_number() OVER (ORDER BY encode(url)) AS nth FROM pages")
def byte_order_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls in byte order. The SQL leaves the order of equal urls open; here they are in that of page_id."""
    keys = _table(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("key"))
    return _nth(keys, "key", "page_id").select("page_id", F.hex("key").alias("url_hex"), "nth")


@_register("composite_key_scan", "SELECT printf('%016x', conv_id) || printf('%016x', turn) AS key_hex, text AS value FROM conversations WHERE conv_id = 5 OR (conv_id = 6 AND turn < 2)")
def composite_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(composite_key(unsigned_key(F.col("conv_id")), unsigned_key(F.col("turn"))).alias("key"), F.col("text").cast("binary").alias("value"), F.lit(False).alias("deleted"), F.lit(0).alias("seq"), F.lit(0).alias("run_id"))
    return _shown(resolve.scan(rows, Included(_k(5) + _k(0)), Excluded(_k(6) + _k(2))))


# -- queries that go through a store on disk ----------------------------------------------------


def scratch_dir(spark: SparkSession) -> str:
    """A new directory in the shared folder; a machine's own temporary one only in local mode without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="stratakv-")
    path = root.removeprefix("file://")
    if "://" in path:
        raise ValueError("a store needs a POSIX file system that driver and executors share")
    path = os.path.join(path, f"kv-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _filled(spark: SparkSession, sf_dir: str):
    """A store with the op-log's bands as four runs, oldest first."""
    store = Builder().target_sstable_size_bytes(1 << 20).open(spark, scratch_dir(spark))
    log = oplog(spark, sf_dir)
    for band in range(RUNS):
        store.apply_many(log.where(F.col("run_id") == band).drop("run_id"))
    return store


@_register("store_scan", _sql("SELECT key_hex, value FROM live"))
def store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_filled(spark, sf_dir).scan())


@_register("store_multi_get", SQL["multi_get"])
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "customer").select(unsigned_key(F.col("c_custkey")).alias("key"))
    return _shown(_filled(spark, sf_dir).multi_get(keys))


@_register("compact_equals_scan", _sql("SELECT key_hex, value FROM live"))
def compact_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    store.compact()
    return _shown(store.scan())


@_register("compact_drops_tombstones", _sql("SELECT (SELECT count(*) FROM (SELECT DISTINCT run_id, key_hex FROM log))::BIGINT AS before_rows, (SELECT count(*) FROM live)::BIGINT AS after_rows, 0::BIGINT AS after_deleted"))
def compact_drops_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    before = sum(r.rows for r in store.manifests.load().runs)
    store.compact()
    after = store.records().agg(F.count("*").alias("after_rows"), F.coalesce(F.sum(F.col("deleted").cast("long")), F.lit(0)).alias("after_deleted"))
    return after.select(F.lit(before).cast("long").alias("before_rows"), "after_rows", "after_deleted")


@_register("compact_then_overlay", _sql("SELECT key_hex, CASE WHEN user_id % 3 = 0 THEN 'newer' ELSE value END AS value FROM live WHERE user_id % 5 <> 0 OR user_id % 3 = 0 UNION ALL SELECT key_hex, 'newer' FROM newest WHERE deleted AND user_id % 3 = 0"))
def compact_then_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After compaction: every 5th key is deleted, then every 3rd is set, also those that were deleted."""
    store = _filled(spark, sf_dir)
    store.compact()
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    store.delete_many(users.where("user_id % 5 = 0").select(unsigned_key(F.col("user_id")).alias("key")))
    store.put_many(users.where("user_id % 3 = 0").select(unsigned_key(F.col("user_id")).alias("key"), F.lit("newer").alias("value")))
    return _shown(store.scan())


@_register("reopen_equals_scan", _sql("SELECT key_hex, value FROM live"))
def reopen_equals_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _filled(spark, sf_dir)
    return _shown(Builder().open(spark, store.root).scan())


@_register("stream_ingest", _sql("SELECT key_hex, value FROM live"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The op-log as a stream of four files, one micro-batch and one run each."""
    from .streaming.ingest import ingest

    root = scratch_dir(spark)
    source, state, data = (os.path.join(root, n) for n in ("source", "state", "data"))
    os.makedirs(data)
    log = oplog(spark, sf_dir)
    for band in range(RUNS):
        log.where(F.col("run_id") == band).drop("run_id").coalesce(1).write.mode("append").parquet("file://" + source)
    store = Builder().open(spark, data)
    stream = spark.readStream.schema(log.drop("run_id").schema).option("maxFilesPerTrigger", 1).parquet("file://" + source)
    ingest(stream, store, "stream_ingest", "file://" + state, availableNow=True).awaitTermination()
    return _shown(store.scan())


@_register("op_counts", _sql("SELECT run_id, sum(CASE WHEN deleted THEN 0 ELSE 1 END)::BIGINT AS writes, sum(CASE WHEN deleted THEN 1 ELSE 0 END)::BIGINT AS deletes FROM log GROUP BY run_id"))
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's own counters, after each band."""
    store, log, counts = Builder().open(spark, scratch_dir(spark)), oplog(spark, sf_dir), []
    for band in range(RUNS):
        before = (store.metrics.writes, store.metrics.deletes)
        store.apply_many(log.where(F.col("run_id") == band).drop("run_id"))
        counts.append((band, store.metrics.writes - before[0], store.metrics.deletes - before[1]))
    return spark.createDataFrame(counts, "run_id long, writes long, deletes long")


def _store_range(name: str, lower: Bound, upper: Bound, test: str, compacted: bool) -> None:
    @_register(name, _sql(f"SELECT key_hex, value FROM live WHERE {test}"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _filled(spark, sf_dir)
        if compacted:
            store.compact()
        return _shown(store.scan(lower, upper))


_store_range("store_scan_bounded", Included(_k(20)), Excluded(_k(77)), "user_id >= 20 AND user_id < 77", compacted=False)
_store_range("store_scan_bounded_base", Excluded(_k(20)), Included(_k(77)), "user_id > 20 AND user_id <= 77", compacted=True)


def _store_get(name: str, sql: str, change: Callable) -> None:
    @_register(name, _sql(f"SELECT n_nationkey::BIGINT AS id, ({sql}) AS value FROM nation"))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = change(_filled(spark, sf_dir))
        ids = [r["n_nationkey"] for r in _table(spark, sf_dir, "nation").select("n_nationkey").collect()]  # 25 rows at every scale
        found = [(i, None if (v := store.get(_k(i))) is None else v.decode()) for i in ids]
        return spark.createDataFrame(found, "id long, value string")


def _compacted(store):
    store.compact()
    return store


def _overwritten(store):
    """Single writes over the runs: some in a run of their own, some in a buffer."""
    store.compact()
    for i in range(0, 25, 3):
        store.set(_k(i), f"single{i}")
    store.buffers.seal()
    store.flush_oldest_memtable()
    for i in range(0, 25, 4):
        store.delete(_k(i))
    return store


_LIVE_VALUE = "SELECT value FROM live WHERE user_id = n_nationkey"
_store_get("store_get_runs", _LIVE_VALUE, lambda store: store)
_store_get("store_get_base", _LIVE_VALUE, _compacted)
_store_get("store_get_layers", f"CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 'single' || n_nationkey ELSE ({_LIVE_VALUE}) END", _overwritten)


def _single_writes(spark: SparkSession, sf_dir: str, threshold: int):
    """The names of nations set one by one, every fifth deleted again; buffers of threshold writes."""
    store = Builder().wal_write_threshold(threshold).open(spark, scratch_dir(spark))
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows at every scale
    writes = [(store.set, r["n_nationkey"], (r["n_name"],)) for r in rows] + [(store.delete, r["n_nationkey"], ()) for r in rows if r["n_nationkey"] % 5 == 0]
    for write, i, value in writes:
        try:
            write(_k(i), *value)
        except NeedFlush:
            store.flush_oldest_memtable()
            write(_k(i), *value)
    return store


_NATIONS_SQL = "SELECT printf('%016x', n_nationkey) AS key_hex, n_name AS value FROM nation WHERE n_nationkey % 5 <> 0"


@_register("store_flush_then_scan", _NATIONS_SQL)
def store_flush_then_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers of seven writes: flushed runs, a frozen buffer and an active one, in one scan."""
    return _shown(_single_writes(spark, sf_dir, 7).scan())


@_register("store_replay", _NATIONS_SQL)
def store_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing but the log is on disk when the store is opened again."""
    store = _single_writes(spark, sf_dir, 1000)
    return _shown(Builder().open(spark, store.root).scan())


@_register("validate_rejects", _REASON_SQL)
def validate_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What apply_many() routes away, by reason, and what it stores, tombstones included."""
    store = Builder().open(spark, scratch_dir(spark))
    bad = store.apply_many(_planted(spark, sf_dir).withColumnRenamed("doc_id", "seq"), on_reject="route")
    stored = store.records().agg(F.count("*").alias("n_rows")).select(F.lit("accepted").alias("reason"), "n_rows")
    return bad.groupBy("reason").agg(F.count("*").alias("n_rows")).unionByName(stored)


@_register("scan_prefix", "SELECT printf('%016x', conv_id) || printf('%016x', turn) AS key_hex, text AS value FROM conversations WHERE conv_id = 5")
def scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of one conversation, by the first half of their keys."""
    store = Builder().open(spark, scratch_dir(spark))
    rows = _table(spark, sf_dir, "conversations").where("octet_length(text) > 0")
    store.put_many(rows.select(composite_key(unsigned_key(F.col("conv_id")), unsigned_key(F.col("turn"))).alias("key"), F.col("text").cast("binary").alias("value")))
    return _shown(store.scan_prefix(_k(5)))


@_register("tiered_compaction", _sql("SELECT key_hex, value FROM live"))
def tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs merged above the base, then two more over them: answers stay."""
    store = Builder().compaction(TieredCompaction(width=2, share=1)).open(spark, scratch_dir(spark))
    log = oplog(spark, sf_dir)
    for band in range(RUNS):
        store.apply_many(log.where(F.col("run_id") == band).drop("run_id"))
        store.compact()
    return _shown(store.scan())
