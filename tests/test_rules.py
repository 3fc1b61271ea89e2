"""Semantics of keys, values, bounds and the merge, without a store."""

import pytest
from pyspark.sql import functions as F

from stratakv import UNBOUNDED, Excluded, Included, errors
from stratakv.functions.keys import signed_bytes, signed_key, successor, unsigned_bytes, unsigned_key
from stratakv.functions.validate import check_key, check_value, split
from stratakv.plans import resolve
from stratakv.plans.bounds import may_overlap
from stratakv.plans.sizing import files_for, greedy_cuts

LOG = "key binary, value binary, deleted boolean, seq long, run_id long"


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), None if v is None else bytearray(v), v is None, s, r) for k, v, s, r in rows], LOG)


def pairs(df):
    return [(bytes(r["key"]), r["value"] and bytes(r["value"])) for r in df.collect()]


def test_sizes_are_checked_in_order():
    for key, value, error in ((b"", b"v", errors.KeyEmpty), (b"k" * 10_241, b"", errors.KeyTooLarge)):
        with pytest.raises(error):
            check_key(key)
            check_value(value)
    with pytest.raises(errors.ValueEmpty):
        check_value(b"")
    with pytest.raises(errors.ValueTooLarge):
        check_value(b"v" * 102_401)
    check_key(b"k" * 10_240)
    check_value(b"v" * 102_400)


def test_bulk_validation_names_the_first_broken_rule(spark):
    rows = [(b"", b"v"), (b"k" * 10_241, b""), (b"k", b""), (b"k", b"v" * 102_401), (b"k" * 10_240, b"v" * 102_400), (None, b"v"), (b"k", None)]
    df = spark.createDataFrame([(k and bytearray(k) if k else k, v and bytearray(v) if v else v, i) for i, (k, v) in enumerate(rows)], "key binary, value binary, i int").withColumn("deleted", F.lit(False))
    good, bad = split(df)
    assert [r["i"] for r in good.collect()] == [4]
    assert {r["i"]: r["reason"] for r in bad.collect()} == {0: "KeyEmpty", 1: "KeyTooLarge", 2: "ValueEmpty", 3: "ValueTooLarge", 5: "KeyEmpty", 6: "ValueEmpty"}


def test_newest_record_wins_even_if_it_is_a_tombstone(spark):
    rows = log(spark, [(b"a", b"old", 9, 1), (b"a", None, 0, 2), (b"b", None, 0, 1), (b"b", b"back", 0, 2), (b"c", b"1", 1, 1), (b"c", b"2", 2, 1)])
    assert pairs(resolve.scan(rows)) == [(b"b", b"back"), (b"c", b"2")]
    assert resolve.latest(rows).count() == 3


def test_byte_order(spark):
    keys = [b"\x00", b"\x00\x01", b"\x01", b"a", b"aa", b"ab", b"b", b"\x7f", b"\x80", b"\xff", "é".encode(), "日本".encode()]
    rows = log(spark, [(k, b"v", 0, 0) for k in reversed(keys)])
    assert [k for k, _ in pairs(resolve.scan(rows))] == sorted(keys)


BOUNDS = [(lo, hi) for lo in (UNBOUNDED, Included(b"b"), Excluded(b"b"), Included(b""), Included(b"bb")) for hi in (UNBOUNDED, Included(b"d"), Excluded(b"d"), Included(b"zz"), Excluded(b"b"), Included(b"b"))]


@pytest.mark.parametrize(("lower", "upper"), BOUNDS)
def test_all_bounds(spark, lower, upper):
    keys = [b"a", b"b", b"c", b"d", b"e"]
    rows = log(spark, [(k, k, 0, 0) for k in keys])
    above = lambda k: lower is UNBOUNDED or k > lower.key or (isinstance(lower, Included) and k == lower.key)
    below = lambda k: upper is UNBOUNDED or k < upper.key or (isinstance(upper, Included) and k == upper.key)
    want = [k for k in keys if above(k) and below(k)]
    assert [k for k, _ in pairs(resolve.scan(rows, lower, upper))] == want
    if want:
        assert may_overlap(b"a", b"e", lower, upper)


def test_key_encodings_keep_order(spark):
    ids = [-(1 << 62), -1400, -1, 0, 1, 500, 1 << 62]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", signed_key(F.col("i")).alias("key"))
    assert [r["i"] for r in df.orderBy("key").collect()] == ids
    assert all(bytes(r["key"]) == signed_bytes(r["i"]) for r in df.collect())
    one = spark.createDataFrame([(300,)], "i long").select(unsigned_key(F.col("i")).alias("key")).first()
    assert bytes(one["key"]) == unsigned_bytes(300)
    assert successor(b"ab") == b"ac"
    assert successor(b"a\xff\xff") == b"b"
    assert successor(b"\xff") is None


def test_bounds_reach_the_scan_and_tombstones_stay_above(spark, tmp_path):
    log(spark, [(b"a", b"1", 0, 0)]).write.parquet(str(tmp_path / "r"))
    plan = resolve.scan(spark.read.parquet(str(tmp_path / "r")), Included(b"a"), Excluded(b"c"))._jdf.queryExecution().executedPlan().toString()
    pushed = [x for x in plan.splitlines() if "PushedFilters" in x][0]
    assert "GreaterThanOrEqual(key" in pushed
    assert "LessThan(key" in pushed
    assert "deleted" not in pushed.split("PushedFilters")[1].split("ReadSchema")[0]


def test_multi_get(spark):
    rows = log(spark, [(b"a", b"1", 0, 1), (b"b", b"1", 0, 1), (b"b", None, 0, 2)])
    keys = spark.createDataFrame([(bytearray(k),) for k in (b"a", b"b", b"x", b"a")], "key binary")
    assert sorted(pairs(resolve.multi_get(rows, keys)), key=str) == sorted([(b"a", b"1"), (b"a", b"1"), (b"b", None), (b"x", None)], key=str)


def test_size_estimate_follows_updates_and_deletes(spark):
    def size(*rows):
        return resolve.size_estimate(log(spark, [(k, v, i, 0) for i, (k, v) in enumerate(rows)])).first()["size_bytes"]

    base = [(b"key1", b"v" * 6), (b"key2", b"v" * 6), (b"key3", b"v" * 6), (b"key1", b"v" * 8), (b"key2", b"v" * 8)]
    assert size(*base) == 34
    assert size(*base, (b"key2", None)) == 26
    assert size(*base, (b"key2", None), (b"key4", None)) == 30
    assert size(*base, (b"key2", None), (b"key4", None), (b"key1", None)) == 22
    assert size(*base, (b"key2", None), (b"key4", None), (b"key1", b"v" * 12)) == 34


def test_file_sizing():
    assert files_for(0, 10) == 1
    assert files_for(21, 10) == 3
    assert greedy_cuts([128] * 100, 1024) == [9] * 11 + [1]
    assert greedy_cuts([], 10) == []
