"""Sharding along a Hilbert curve over metadata, in DataFrame functions only.

Each dimension is quantised to `bits` bits by rank: a value's quantum is the share of rows with smaller
values, so quanta keep the order of numbers and of texts, and hold about equally many rows where values
allow it. The cells' indices on the Hilbert curve order the rows, and the ordered rows are cut into runs
whose row counts differ by one at most. A run holds few cells, neighbours in all dimensions at once, so
min-max statistics of its file prune on any of them; write() makes such files.

Defined results: null and NaN in a dimension come before all values; rows of a cell are ordered by a hash
of the id (null counts as empty), then size and text checksum, so reruns agree; rows equal in all of
these are interchangeable; with fewer rows than shards some shards are empty; an empty table gives an
empty result. Extra columns are not read.

Plan: a dimension's cuts come from its distinct values, counted before the shuffle, laid out by range and
summed inside ranges; 2 ** bits - 1 values of each dimension reach the driver. A row's rank is (rows in
cells before) + (rows in earlier sub-cells of its cell) + (rank in its sub-cell). Cells are at most
2 ** (bits * dimensions), a fixed number, and one window orders their counts. Sub-cells split cells by id
hash, so many that one holds about `SUB_ROWS` rows even if all rows share a cell; sums over them are taken
on three levels (prefix.py). No window holds all rows or one hot cell.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .prefix import sums_before

SUB_ROWS = 4096
BITS = 4


def _value(column: str, kind: str) -> Column:
    """The column as something that has an order; NaN is null."""
    c = F.col(column)
    if kind in ("float", "double"):
        return F.when(~F.isnan(c), c)
    return c.cast("string") if kind.startswith(("map", "array", "struct", "variant")) else c


def cuts(rows: DataFrame, column: str, n_rows: int, bits: int = BITS) -> list[tuple[int, object]]:
    """(quantum, its smallest value) in order, of at most 2 ** bits quanta; a quantum is rows before * 2 ** bits / n_rows."""
    values = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    laid = materialize(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "shard-values")
    # One row a partition.
    parts = laid.groupBy("part").agg(F.sum("n").alias("m"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("m").over(ahead(Window.partitionBy(F.lit(0)).orderBy("part"))), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(ahead(Window.partitionBy("part").orderBy(F.asc_nulls_first("v")))), F.lit(0))
    placed = laid.withColumn("inside", inside).join(parts, "part").where("v IS NOT NULL")
    # Rows before times 2 ** bits stays below 2 ** 63 for 10 ** 17 rows.
    quantum = F.expr(f"((first + inside) * {1 << bits}) div {max(n_rows, 1)}").cast("int")
    found = placed.groupBy(quantum.alias("q")).agg(F.min("v").alias("v")).where("q > 0").orderBy("q").collect()
    return [(r["q"], r["v"]) for r in found]


def quantum(value: Column, edges: list[tuple[int, object]]) -> Column:
    """The last quantum whose smallest value is not above value; 0 for null."""
    tests = reduce(lambda c, e: (F.when if c is None else c.when)(value >= F.lit(e[1]), F.lit(e[0])), reversed(edges), None)
    return F.lit(0) if tests is None else tests.otherwise(0)


def curve_index(coordinates: list[int], bits: int) -> int:
    """Index of a cell on the Hilbert curve.

    Level by level from the coarsest: the cell's corner of the current cube, read as a number in
    Gray code, is the next digit; then the cube is turned to the frame of the corner's sub-cube.
    """
    n, entry, turn, index = len(coordinates), 0, 0, 0
    mask = (1 << n) - 1
    rotate = lambda v, k: ((v >> k) | (v << (n - k))) & mask
    for level in range(bits - 1, -1, -1):
        corner = sum(((x >> level) & 1) << i for i, x in enumerate(coordinates))
        code = rotate(corner ^ entry, (turn + 1) % n)
        digit, shift = code, 1
        while shift < n:
            digit ^= digit >> shift
            shift <<= 1
        index = (index << n) | digit
        # Where the curve enters the sub-cube of this digit, and along which axis it leaves.
        even = 2 * ((digit - 1) // 2) if digit else 0
        step = (digit - 1 if digit % 2 == 0 else digit) if digit else 0
        enters = even ^ (even >> 1)
        axis = ((step + 1) & -(step + 1)).bit_length() - 1 if step else 0
        back = (turn + 1) % n
        entry ^= ((enters << back) | (enters >> (n - back))) & mask
        turn = (turn + axis % n + 1) % n
    return index


def order(docs: DataFrame, dimensions: list[str], bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, quanta..., curve, rank, n_rows): rank is gapless from 0 along the curve."""
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    q, v = [f"q{i}" for i in range(len(dimensions))], [f"v{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[_value(c, kinds[c]).alias(n) for c, n in zip(dimensions, v, strict=True)],
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    rows = materialize(rows, "shard-rows")
    n_rows = rows.count()
    subs = max(1, -(-n_rows // SUB_ROWS))
    edges = [cuts(rows, n, n_rows, bits) for n in v]
    # The curve as a table of all cells: a fixed number of rows, made from the rule.
    cells = [(*c, curve_index(list(c), bits)) for c in product(range(1 << bits), repeat=len(dimensions))]
    curve = docs.sparkSession.createDataFrame(cells, ", ".join(f"{n} int" for n in q) + ", curve int")
    quanta = rows.select("doc_id", "size", "text_crc32", "h", *[quantum(F.col(n), e).cast("int").alias(m) for n, e, m in zip(v, edges, q, strict=True)])
    # Sub-cells follow the order of the hash.
    sub = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long").cast("double") / float(1 << 32) * subs).cast("long")
    keyed = quanta.join(F.broadcast(curve), q).withColumn("sub", sub)
    counts = materialize(keyed.groupBy("curve", "sub").agg(F.count("*").alias("n")), "shard-counts")
    every = Window.partitionBy(F.lit(0)).orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cell_start = counts.groupBy("curve").agg(F.sum("n").alias("n")).select("curve", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("cell_start"))
    starts = sums_before(counts, ["curve"], "sub", "n", "sub_start").join(cell_start, "curve").select("curve", "sub", (F.col("cell_start") + F.col("sub_start")).alias("first"))
    inside = Window.partitionBy("curve", "sub").orderBy("h", "size", "text_crc32")
    ranked = keyed.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["curve", "sub"])
    return ranked.select("doc_id", "size", "text_crc32", *q, "curve", (F.col("first") + F.col("nth")).alias("rank"), F.lit(n_rows).cast("long").alias("n_rows"))


def shard(docs: DataFrame, dimensions: list[str], shards: int = 16, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """order(), cut into runs: shard and the row's slot in it."""
    ranked = order(docs, dimensions, bits, id_col, text_col)
    # Integer arithmetic: shard s begins at ceil(s * n / shards).
    cut = ranked.withColumn("shard", F.expr(f"(rank * {shards}) div n_rows").cast("int"))
    return cut.withColumn("slot", F.col("rank") - F.expr(f"(shard * n_rows + {shards - 1}) div {shards}"))


def write(docs: DataFrame, path: str, dimensions: list[str], shards: int = 16, file_rows: int = 1_000_000, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """docs as Parquet files at path, one for each run of file_rows rows of a shard, in the curve's order.

    Files are in folders hilbert_shard=s/hilbert_run=r; readers skip those whose min-max statistics, or
    folders, miss a predicate.
    """
    placed = materialize(shard(docs, dimensions, shards, bits, id_col, text_col), "shard-places")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_size": (F.octet_length(text) + 1).cast("long"), "_crc": F.crc32(text.cast("binary"))}
    mine = docs
    for name, c in keys.items():
        mine = mine.withColumn(name, c)
    # Rows that agree in id and text are told apart by their number among them; which has which is free.
    same = Window.partitionBy(id_col, *keys)
    mine = mine.withColumn("_nth", F.row_number().over(same.orderBy(*dimensions)))
    theirs = placed.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot", "rank")
    theirs = theirs.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_size", "_crc").orderBy("rank")))
    m, t = mine.alias("m"), theirs.select("_id", "_size", "_crc", "_nth", F.col("shard").alias("hilbert_shard"), F.expr(f"slot div {file_rows}").alias("hilbert_run"), F.col("slot").alias("_slot")).alias("t")
    met = m.join(t, F.col(f"m.{id_col}").eqNullSafe(F.col("t._id")) & F.expr("m._size = t._size AND m._crc = t._crc AND m._nth = t._nth"))
    out = met.select(*[F.col(f"m.{c}").alias(c) for c in docs.columns], "t.hilbert_shard", "t.hilbert_run", "t._slot")
    run = ["hilbert_shard", "hilbert_run"]
    out.repartition(*run).sortWithinPartitions(*run, "_slot").drop("_slot").write.partitionBy(*run).parquet(path)


def report(sharded: DataFrame) -> DataFrame:
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle(dimensions: list[str], shards: int = 16, bits: int = BITS) -> str:
    """SQL of report(shard(documents)): ranks for quanta, the curve as a table made from the rule, and CRC-32
    by its table of 256 remainders, made from the polynomial."""
    cells = ", ".join(f"({', '.join(map(str, c))}, {curve_index(list(c), bits)})" for c in product(range(1 << bits), repeat=len(dimensions)))
    q = [f"q{i}" for i in range(len(dimensions))]
    quanta = ", ".join(f"(rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER () AS {n}" for c, n in zip(dimensions, q, strict=True))
    step = "i"
    for _ in range(8):
        step = f"(CASE WHEN {step} % 2 = 1 THEN xor({step} // 2, 3988292384) ELSE {step} // 2 END)" if step == "i" else f"list_transform([{step}], lambda x: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)[1]"
    return f"""
WITH remainders AS (
  SELECT list({step} ORDER BY i) AS t FROM (SELECT unnest(range(0, 256))::BIGINT AS i)
), d AS (
  SELECT doc_id, {', '.join(dimensions)}, coalesce(text, '') AS text, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT doc_id, {', '.join(dimensions)}, h, octet_length(encode(text)) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda crc, b: xor(crc >> 8, t[(xor(crc, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, remainders
), k AS (
  SELECT *, {quanta} FROM c
), curve({', '.join(q)}, curve) AS (
  VALUES {cells}
), r AS (
  SELECT *, row_number() OVER (ORDER BY curve, h, size, text_crc32) - 1 AS rank, count(*) OVER () AS n FROM k JOIN curve USING ({', '.join(q)})
), s AS (
  SELECT *, rank * {shards} // n AS shard FROM r
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (rank - (shard * n + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""
