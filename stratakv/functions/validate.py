"""Size rules of keys and values: for one write, and for a DataFrame of writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..schema import MAX_KEY_BYTES, MAX_VALUE_BYTES


def check_key(key: bytes) -> None:
    if not key:
        raise errors.KeyEmpty
    if len(key) > MAX_KEY_BYTES:
        raise errors.KeyTooLarge


def check_value(value: bytes) -> None:
    if not value:
        raise errors.ValueEmpty
    if len(value) > MAX_VALUE_BYTES:
        raise errors.ValueTooLarge


def reject_reason(key: Column, value: Column, deleted: Column | None = None) -> Column:
    """The first rule that a write breaks, by name, or null. Null keys and values count as empty."""
    k, v = F.coalesce(F.octet_length(key), F.lit(0)), F.coalesce(F.octet_length(value), F.lit(0))
    set_ = ~deleted if deleted is not None else F.lit(True)
    return F.when(k == 0, "KeyEmpty").when(k > MAX_KEY_BYTES, "KeyTooLarge").when(set_ & (v == 0), "ValueEmpty").when(set_ & (v > MAX_VALUE_BYTES), "ValueTooLarge")


def split(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes (key, value, deleted, ...) that may be stored, and the others with their reason."""
    judged = writes.withColumn("reason", reject_reason(F.col("key"), F.col("value"), F.col("deleted")))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def strict(writes: DataFrame) -> DataFrame:
    """Writes as they are; the job fails at the first that breaks a rule."""
    reason = reject_reason(F.col("key"), F.col("value"), F.col("deleted"))
    return writes.withColumn("key", F.when(reason.isNull(), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("rejected write: "), reason)).cast("binary")))
