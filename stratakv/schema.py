"""Record schemas and limits."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MAX_KEY_BYTES = 10_240
MAX_VALUE_BYTES = 102_400

PUBLIC = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
#: A write: value is null if and only if the key is deleted; the highest seq of a batch is the newest.
OPLOG = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("deleted", T.BooleanType(), False), T.StructField("seq", T.LongType(), False)])
#: A stored row: run names the run's files; the manifest gives each run its age.
STORED = T.StructType([*OPLOG.fields, T.StructField("run", T.LongType(), False)])
_ARROW = pa.schema([("key", pa.binary()), ("value", pa.binary()), ("deleted", pa.bool_()), ("seq", pa.int64())])


def local_oplog(spark: SparkSession, rows: dict[bytes, bytes | None]) -> DataFrame:
    """A write buffer's records as a DataFrame whose size the planner knows."""
    values = list(rows.values())
    table = pa.table([list(rows), values, [v is None for v in values], [0] * len(values)], schema=_ARROW)
    return spark.createDataFrame(table)
