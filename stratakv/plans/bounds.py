"""Ends of a key range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Included:
    key: bytes


@dataclass(frozen=True)
class Excluded:
    key: bytes


@dataclass(frozen=True)
class _Unbounded:
    pass


UNBOUNDED = _Unbounded()
Bound = Included | Excluded | _Unbounded


def in_bounds(key: Column, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> Column | None:
    """Predicate on the key, or None if it holds for all. An empty lower key begins before all keys."""
    tests = []
    if not isinstance(lower, _Unbounded) and lower.key:
        low = F.lit(bytearray(lower.key))
        tests.append(key >= low if isinstance(lower, Included) else key > low)
    if not isinstance(upper, _Unbounded):
        high = F.lit(bytearray(upper.key))
        tests.append(key <= high if isinstance(upper, Included) else key < high)
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def restrict(rows: DataFrame, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> DataFrame:
    test = in_bounds(F.col("key"), lower, upper)
    return rows if test is None else rows.where(test)


def may_overlap(least: bytes, most: bytes, lower: Bound = UNBOUNDED, upper: Bound = UNBOUNDED) -> bool:
    """Whether a run with these extreme keys can hold a key of the range."""
    if not isinstance(lower, _Unbounded) and (most < lower.key or (isinstance(lower, Excluded) and most == lower.key)):
        return False
    return isinstance(upper, _Unbounded) or not (least > upper.key or (isinstance(upper, Excluded) and least == upper.key))
