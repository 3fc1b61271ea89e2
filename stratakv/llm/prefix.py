"""Running sums without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window orders, as long as a group has at most WIDTH ** 3.
WIDTH = 1024


def sums_before(rows: DataFrame, group: list[str], position: str, value: str, out: str, width: int = WIDTH) -> DataFrame:
    """rows with out: the sum of value over the rows of the same group at smaller positions.

    Positions are whole numbers from 0 on, one row each in a group; group columns are not null. Sums are
    taken on three levels: inside runs of `width` positions, over the runs of a stretch of `width` runs,
    and over the stretches, so a group of n positions is ordered n / width ** 2 rows at a time at most.
    """
    run, stretch, v = "_run", "_stretch", "_v"
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, keys, by: F.coalesce(F.sum(c).over(ahead(*keys).orderBy(by)), F.lit(0))
    placed = rows.withColumn(run, F.floor(F.col(position) / width).cast("long"))
    runs = placed.groupBy(*group, run).agg(F.sum(value).alias(v)).withColumn(stretch, F.floor(F.col(run) / width).cast("long"))
    stretches = runs.groupBy(*group, stretch).agg(F.sum(v).alias(v))
    stretches = stretches.select(*group, stretch, before(v, group, stretch).alias("_s"))
    starts = runs.withColumn("_r", before(v, [*group, stretch], run)).join(stretches, [*group, stretch])
    starts = starts.select(*group, run, (F.col("_r") + F.col("_s")).alias("_start"))
    inside = placed.withColumn("_in", before(value, [*group, run], position))
    return inside.join(starts, [*group, run]).withColumn(out, (F.col("_start") + F.col("_in")).cast("long")).select(*rows.columns, out)
