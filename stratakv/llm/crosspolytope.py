"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations.

Two rows link if their labels are equal and not null and their cosine, in double precision, is 0.98
or more. A rotation (three rounds of random signs and a fast Hadamard transform) takes a vector to the
nearest of the 2d signed axes. Multiprobe: a vector also takes its next nearest axes, `PROBES` in all.
A table has `depth` rotations; a vector enters the buckets of all combinations of its axes there, and
two vectors meet in a table if in each of its rotations any of their axes agree. The depth grows with
the logarithm of a label's vectors, as far as its buckets still hold `DENSE` unlike ones: smaller
buckets cost more to handle than to compare.

Recall: at cosine 0.98 a rotation misses a pair with a probability of about 0.026 at d = 64 and 0.057 at
d = 1024 (`miss()` is above what a test measures); `tables()` takes as many tables as leave a miss below
`LOST` for a pair at the threshold, and far less above it.

Equal vectors of a label are one class, with a count; classes alone are hashed. In a bucket pairs
are compared, never written out: a pair counts in the first of its common buckets only, which each task
decides from the classes' bucket lists, so counts need no set of pairs. A task returns, per class,
the number of linked rows, and of the links only a spanning forest. Buckets of more than `BLOCK`
classes are compared by pairs of blocks, one pair a task, `STRIP` rows at a time, so neither a task nor its
memory grows with a bucket. Cosines within `CLOSE` of the threshold are summed again in one fixed order.

Defined results: null label, and vectors that are null, empty, zero or hold null or non-finite
components: no links, own component. Vectors of different length never link. Vectors are scaled by a
power of two first, so tiny and huge ones link as others do. Rows with null id link
with nothing (component null, kept). Rows that repeat an id and a vector count as copies of it. An
empty table gives an empty result.

Plan: bucket rows carry keys and ids only; buckets of one class go at once; vectors join what is
left. Copies are counted before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, map_arrow, materialize, randoms
from .components import components
from .vptree import scaled, usable

LEAST = 0.98
PROBES = 2
#: Chance that all tables miss a pair at the threshold, at most.
LOST = 1e-9
#: Classes of unlike vectors that a bucket is to hold, about; rotations of a table at most.
DENSE, MOST_DEPTH = 64, 4
#: Most classes of a block, and rows of it that are compared at once with another block.
BLOCK, STRIP = 2048, 256
#: Far more than products of unit vectors are rounded by.
CLOSE = 1e-9
SEED = 91


def depth_for(n: int, d: int) -> int:
    """Most rotations of a table with which n unlike vectors of length d still fill buckets with DENSE."""
    depth = 1
    while depth < MOST_DEPTH and n * PROBES ** (depth + 1) >= DENSE * (2 * width(d)) ** (depth + 1):
        depth += 1
    return depth


def miss(d: int) -> float:
    """Chance that a rotation of vectors of length d misses a pair at the threshold, at most."""
    return max(0.1 if d < 16 else 0.02, 0.0076 * float(np.log2(width(d))) - 0.017)


def tables(depth: int, d: int) -> int:
    """Tables that together lose a pair of length d at the threshold with a chance of LOST at most."""
    return int(np.ceil(np.log(LOST) / np.log(1 - (1 - miss(d)) ** depth)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def width(d: int) -> int:
    """Components of a rotation of vectors of length d; short ones are rotated among 16, for enough signs."""
    return 1 << max(4, int(d - 1).bit_length())


def axes(vectors: np.ndarray, rotation: int, probes: int = PROBES) -> np.ndarray:
    """Rows x probes: the signed axes nearest to the rotated vectors, nearest first."""
    d = width(vectors.shape[1])
    x = np.zeros((len(vectors), d))
    x[:, : vectors.shape[1]] = vectors
    for turn in range(3):
        signs = np.where(randoms(SEED + 7 * rotation + turn, d) >> np.uint64(33) & np.uint64(1), 1.0, -1.0)
        x = hadamard(x * signs)
    near = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    return 2 * near + (np.take_along_axis(x, near, 1) > 0)


def bucket_keys(vectors: np.ndarray, depth: int, n_tables: int, probes: int = PROBES) -> np.ndarray:
    """Rows x tables x probes ** depth: the buckets that each vector enters, table by table."""
    sides = 2 * width(vectors.shape[1])
    out = []
    for t in range(n_tables):
        key = np.full((len(vectors), 1), t, dtype=np.int64)
        for r in range(depth):
            key = (key[:, :, None] * sides + axes(vectors, t * depth + r, probes)[:, None, :]).reshape(len(vectors), -1)
        out.append(key)
    return np.stack(out, axis=1)


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, cuts = np.asarray(column.flatten(), dtype=np.float64), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])
    return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def bucket_rows(classes: DataFrame, depth: int, n_tables: int, probes: int = PROBES) -> DataFrame:
    """(cls, keys): a class's buckets, table by table."""
    n_keys = n_tables * probes**depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                vectors = _rows(part.column(1))
                out = np.zeros((part.num_rows, n_keys), dtype=np.int64)
                sizes = np.array([len(v) for v in vectors])
                for d in np.unique(sizes).tolist():
                    of = np.flatnonzero(sizes == d)
                    out[of] = bucket_keys(scaled(np.stack([vectors[i] for i in of])), depth, n_tables, probes).reshape(len(of), -1)
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * n_keys
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=["cls", "keys"])

    return classes.select("cls", "v").transform(map_arrow, run, "cls long, keys array<long>")


class Forest:
    """Of the links it is shown, those that connect what earlier ones have not."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.a: list[int] = []
        self.b: list[int] = []

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            p, q = self.label[x], self.label[y]
            new = p != q
            x, y, p, q = x[new], y[new], np.minimum(p, q)[new], np.maximum(p, q)[new]
            if not len(x):
                return
            # Each larger label takes one link to a smaller one; the others are looked at again.
            q, one = np.unique(q, return_index=True)
            to = np.arange(len(self.label))
            to[q] = p[one]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
            self.a += x[one].tolist()
            self.b += y[one].tolist()


def compare(i: int, j: int, key: int, cls: np.ndarray, copies: np.ndarray, part: np.ndarray, keys: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of one pair of blocks: per member the linked rows, and a spanning forest (a, b).

    keys: members x tables x buckets; data: scaled vectors.
    """
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    lengths = np.sqrt(np.add.reduce(data * data, axis=1))
    unit = data / lengths[:, None]
    linked, forest = np.zeros(len(cls), dtype=np.int64), Forest(len(cls))
    for at in range(0, len(left), STRIP):
        rough = unit[left[at : at + STRIP]] @ unit[right].T
        x, y = np.nonzero(rough >= LEAST - CLOSE)
        near = np.flatnonzero(rough[x, y] < LEAST + CLOSE)
        x, y = left[at + x], right[y]
        # Decided by one fixed order of summation, a bounded number at a time.
        good = np.ones(len(x), dtype=bool)
        for some in np.split(near, range(4096, len(near), 4096)):
            p, q = x[some], y[some]
            good[some] = np.add.reduce(data[p] * data[q], axis=1) / (lengths[p] * lengths[q]) >= LEAST
        if i == j:
            good &= x < y
        x, y = x[good], y[good]
        # A pair counts in the least of its common buckets; buckets of different tables differ.
        for first in range(0, len(x), 16384):
            p, q = x[first : first + 16384], y[first : first + 16384]
            mine, common = keys[p], np.full(len(p), np.iinfo(np.int64).max)
            for c in range(keys.shape[2]):
                same = np.where(mine == keys[q][:, :, c : c + 1], mine, np.iinfo(np.int64).max)
                common = np.minimum(common, same.min(axis=(1, 2)))
            p, q = p[common == key], q[common == key]
            linked += np.bincount(p, weights=copies[q], minlength=len(cls)).astype(np.int64) + np.bincount(q, weights=copies[p], minlength=len(cls)).astype(np.int64)
            forest.add(p, q)
    return linked, cls[forest.a], cls[forest.b]


def _compared(classes: DataFrame) -> DataFrame:
    """(cls, other, linked): other null: linked rows of a class; else a link."""
    lengths = classes.groupBy("label", F.size("v").alias("d")).count().agg(F.max("count").alias("n"), F.max_by("d", "count").alias("d"), F.max("d").alias("longest")).first()
    depth = depth_for(lengths["n"] or 0, lengths["d"] or 1)
    coded = materialize(bucket_rows(classes, depth, tables(depth, lengths["longest"] or 1)).join(classes.select("cls", "label", F.size("v").alias("d")), "cls"), "cp-keys")
    key = ["label", "d", "key"]
    rows = coded.select("cls", "label", "d", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = materialize(rows.groupBy(*key).agg(F.count("*").alias("m")).where("m > 1"), "cp-buckets")
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    met = rows.join(sizes, key).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    spread = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "cls")
    full = spread.join(classes.select("cls", "copies", "v"), "cls").join(coded.select("cls", "keys"), "cls")
    group, choices = [*key, "i", "j"], PROBES**depth
    dealt = full.repartition(*group).sortWithinPartitions(*group).select(*group, "part", "cls", "copies", "keys", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 5):
            cls, copies, part = (g.column(c).to_numpy() for c in ("cls", "copies", "part"))
            keys = np.asarray(g.column("keys").combine_chunks().flatten()).reshape(len(cls), -1, choices)
            data = scaled(np.asarray(g.column("v").combine_chunks().flatten(), dtype=np.float64).reshape(len(cls), -1))
            own, i, j = (g.column(c)[0].as_py() for c in ("key", "i", "j"))
            linked, a, b = compare(i, j, own, cls, copies, part, keys, data)
            some = np.flatnonzero(linked)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cls[some], a])), pa.array([None] * len(some) + b.tolist(), pa.int64()), pa.array(np.concatenate([linked[some], np.zeros(len(a), np.int64)]))], names=["cls", "other", "linked"])

    return materialize(dealt.transform(map_arrow, run, "cls long, other long, linked long"), "cp-links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors."""
    # Vectors travel as they are, floats as floats; all arithmetic is in double precision.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    zero = F.lit(0.0).cast(kind)
    live = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    # -0.0 and 0.0 are the same component.
    live = live.withColumn("v", F.transform("v", lambda x: x + zero))
    named = live.select("id", "label", F.xxhash64(F.lit(1), "v").alias("f1"), F.xxhash64(F.lit(2), "v").alias("f2"), "v")
    named = materialize(named, "cp-rows")
    same = ["label", "f1", "f2"]
    counted = materialize(named.groupBy(*same).agg(F.min("id").alias("cls"), F.count("*").alias("copies")), "cp-classes")
    # A class's number is its smallest id; where that id has several classes, a hash tells them apart.
    counted = counted.withColumn("several", F.count("*").over(Window.partitionBy("cls")) > 1)
    reps = named.join(counted.select(*same, F.col("cls").alias("id"), "copies", "several"), [*same, "id"]).dropDuplicates([*same])
    number = F.when(F.col("several"), F.xxhash64("id", *same)).otherwise(F.col("id"))
    classes = materialize(reps.select(number.alias("cls"), F.col("id").alias("least"), *same, "copies", "v"), "cp-reps")
    found = _compared(classes)
    links = found.where("other IS NULL").groupBy("cls").agg(F.sum("linked").alias("linked"))
    joined = components(found.where("other IS NOT NULL"), "cls", "other")
    # Components are named after their smallest id.
    met = classes.select("cls", "least", *same, "copies").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").join(links, "cls", "left")
    met = materialize(met.withColumn("component", F.coalesce("component", "cls")), "cp-met")
    least = materialize(met.groupBy("component").agg(F.min("least").alias("component_id")), "cp-least")
    of_class = materialize(met.join(least, "component").select(*same, "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "cp-result")
    per_row = named.select("id", *same).distinct().join(of_class.hint("shuffle_hash"), same)
    valid = usable(F.col("v"))
    hashed = rows.withColumn("v", F.transform("v", lambda x: x + zero)).select("id", F.when(valid, F.col("label")).alias("label"), F.xxhash64(F.lit(1), "v").alias("f1"), F.xxhash64(F.lit(2), "v").alias("f2"))
    out = hashed.join(per_row, ["id", *same], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CASE WHEN embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), n AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM e UNION SELECT links.y, reach.r FROM reach JOIN links ON reach.v = links.x
), least AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least.component_id, e.vec_id = least.component_id AS kept
FROM e LEFT JOIN n ON n.x = e.vec_id JOIN least ON least.v = e.vec_id
"""
