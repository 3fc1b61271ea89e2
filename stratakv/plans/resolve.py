"""The semantic core: the newest record of each key, less the deleted ones, in key order.

All functions are lazy. Predicates on the key may stand on either side of latest() (the optimizer
moves them below it); predicates on anything else must stand above it, for a newer record that fails
the predicate still hides an older one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounds import UNBOUNDED, Bound, restrict


def latest(records: DataFrame, *newest_first: str) -> DataFrame:
    """One record a key: the first by the given columns, descending (default run_id, seq).

    The rank is limited inside each task before rows are shuffled, so a key with very many versions
    costs one row a task.
    """
    order = Window.partitionBy("key").orderBy(*[F.desc(c) for c in newest_first or ("run_id", "seq")])
    return records.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_in_runs(records: DataFrame) -> DataFrame:
    """One record a key and run: what each run holds after its flush. One shuffle for all runs."""
    order = Window.partitionBy("run_id", "key").orderBy(F.desc("seq"))
    return records.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def single(records: DataFrame, reason: str) -> DataFrame:
    """records, one a key; the job fails with the reason if a key has several."""
    counted = records.withColumn("_n", F.count("*").over(Window.partitionBy("key")))
    key = F.when(F.col("_n") == 1, F.col("key")).otherwise(F.raise_error(F.lit(f"rejected write: {reason}")).cast("binary"))
    return counted.withColumn("key", key).drop("_n")


def visible(newest: DataFrame) -> DataFrame:
    """Drop tombstones. Goes after latest(), never before."""
    return newest.where(~F.col("deleted"))


def merge(runs: list[DataFrame]) -> DataFrame:
    """Runs as one set of records; run_id tells their age."""
    return reduce(DataFrame.unionByName, runs)


def over_base(newest: DataFrame, base: DataFrame) -> DataFrame:
    """One record a key of newest (unique keys) laid over base (unique keys, all older).

    Base rows pass straight through but for keys that newest has. While newest is small by the
    planner's own threshold its keys are broadcast and the base, most of the data, is not shuffled.
    """
    kept = base.join(newest.select("key"), "key", "left_anti")
    return newest.select(*base.columns).unionByName(kept)


def scan(records: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED, limit: int | None = None) -> DataFrame:
    """(key, value) of the range in byte order of the key."""
    rows = visible(latest(restrict(records, lower, upper))).select("key", "value").orderBy("key")
    return rows if limit is None else rows.limit(limit)


def named(records: DataFrame, keys: DataFrame) -> DataFrame:
    """The records that keys name."""
    return records.join(keys.select("key").distinct(), "key", "left_semi")


def multi_get(records: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) for each row of keys; value is null if the key is missing or deleted.

    The records that the keys do not name are dropped before the newest are sought. The planner
    broadcasts keys if they are small by its own threshold, and shuffles both sides otherwise.
    """
    found = visible(latest(named(records, keys))).select("key", "value")
    return keys.select("key").join(found, "key", "left")


def size_estimate(records: DataFrame) -> DataFrame:
    """(size_bytes, n_keys): bytes of the newest keys and values; a tombstone counts its key alone."""
    newest = latest(records)
    return newest.agg(F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))), F.lit(0)).alias("size_bytes"), F.count("*").alias("n_keys"))


def key_ranges(records: DataFrame) -> DataFrame:
    """(run_id, min_key, max_key, n_records): extreme keys of each run."""
    return records.groupBy("run_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_records"))


def sequence_gaps(log: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, n_records, first_seq, n_gaps): places where a log's seq does not follow its predecessor."""
    order = Window.partitionBy(by).orderBy("seq")
    step = F.col("seq") - F.lag("seq").over(order)
    return log.withColumn("step", step).groupBy(by).agg(F.count("*").alias("n_records"), F.min("seq").alias("first_seq"), F.sum(F.when(F.col("step") != 1, 1).otherwise(0)).cast("long").alias("n_gaps"))
