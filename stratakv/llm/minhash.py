"""Near-duplicate documents: banded MinHash candidates, Odd sketches, exact confirmation.

A document's set holds its distinct runs of five words (all words, if it has fewer), ASCII letters
lower-cased. `BANDS` bands of `ROWS` MinHash samples name buckets; documents of Jaccard similarity
0.75 share none with a probability below 1e-6. All samples are also folded into a parity bitmap of
`SKETCH_BITS` bits (an Odd sketch): the XOR of two bitmaps has about n/2 * (1 - exp(-2d/n)) bits
set, d being the number of samples in which the two differ, twice counted. A pair whose estimate is
more than 5.5 standard errors below the threshold is dropped; all others are compared on full sets.

Equal sets are one class, found by a 128-bit sum of their hashes; classes alone take part.

Inside a bucket no set of all pairs is made. First every member meets four leaders of its bucket: its
smallest and largest class, and two chosen by hash. That settles buckets of up to three, and confirmed
links give components. Buckets that still hold several components are compared in full, pairs of
blocks of at most `BLOCK` members a task, each pair of members in its first common bucket only: once on
sketches alone, which tells the few members that may have a link to another component, and then,
with these members' full sets at hand, exactly. A task returns links that join components it has not
seen joined, fewer than it has members.

Defined results: null, empty and blank texts have the empty set and no links; rows with null doc_id
take part in nothing (component null, kept); rows with the same doc_id are one node and share all
links of any of them; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import groups, map_arrow, materialize, mix64, randoms, slices, text_bytes, window_hashes, word_hashes
from .components import components

WORDS = 5
PERCENT = 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Rows whose sketches are made at once: they pass through 8 bytes a bit.
SKETCH_ROWS = 1024
#: Least estimate: 0.75 less 5.5 standard errors of a mean over SAMPLES samples.
LEAST = 0.75 - 5.5 * (0.75 * 0.25 / SAMPLES) ** 0.5
#: Most members of a block, and most shingles (8 bytes each) of its members' sets, but for one member.
BLOCK, BLOCK_SHINGLES = 4096, 2_000_000
SEED = 31


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows, and the rows' offsets into them."""
    words, _, _, bounds = word_hashes(*text_bytes(texts), lower=True)
    n = np.diff(bounds)
    runs, at = window_hashes(words, bounds, WORDS, SEED)
    rows = np.repeat(np.arange(len(n)), np.diff(at))
    # Fewer than WORDS words: the whole sequence is one shingle.
    for k in range(1, WORDS):
        few = np.flatnonzero(n == k)
        if len(few):
            whole, _ = window_hashes(words, np.array([0, len(words)]), k, SEED + k)
            at = np.searchsorted(rows, few)
            runs, rows = np.insert(runs, at, whole[bounds[few]]), np.insert(rows, at, few)
    cuts = np.searchsorted(rows, np.arange(len(n) + 1))
    sets = [np.unique(runs[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    offsets = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=offsets[1:])
    return np.concatenate([np.zeros(0, np.uint64), *sets]), offsets


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Non-empty rows x SAMPLES: the samples' least hashes."""
    multipliers, adders = randoms(SEED + 10, SAMPLES), randoms(SEED + 11, SAMPLES)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), SAMPLES), dtype=np.uint32)
    # Runs of rows that fit in the cache, all samples over each.
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + 16384)))
            end = starts[last] if last < len(starts) else offsets[-1]
            part, cuts = sets[starts[first] : end], starts[first:last] - starts[first]
            for j in range(SAMPLES):
                hashed = ((part * multipliers[j] + adders[j]) >> np.uint64(32)).astype(np.uint32)
                out[first:last, j] = np.minimum.reduceat(hashed, cuts)
            first = last
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    wide = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(samples), BANDS)).copy()
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, i] + np.uint64(1))
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Rows x SKETCH_BITS / 64 words: bit b is the parity of the number of samples that hash to b."""
    if len(samples) > SKETCH_ROWS:
        return np.concatenate([odd_sketches(samples[i : i + SKETCH_ROWS]) for i in range(0, len(samples), SKETCH_ROWS)])
    n = len(samples)
    with np.errstate(over="ignore"):
        bit = (mix64(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = np.bincount((np.arange(n)[:, None] * SKETCH_BITS + bit).ravel(), minlength=n * SKETCH_BITS) & 1
    packed = np.packbits(flat.astype(np.uint8).reshape(n, SKETCH_BITS), axis=1, bitorder="little")
    return packed.view(np.int64)


def most_odd_bits() -> int:
    """Most bits in the XOR of two sketches whose estimated similarity is LEAST or more."""
    differ = 2 * SAMPLES * (1 - LEAST)
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp(-2 * differ / SKETCH_BITS))))


def set_names(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of hashes of each row's set; 0 for the empty set."""
    has = np.diff(offsets) > 0
    f1, f2 = np.zeros(len(has), np.uint64), np.zeros(len(has), np.uint64)
    if has.any():
        with np.errstate(over="ignore"):
            f1[has] = np.add.reduceat(mix64(sets), offsets[:-1][has])
            f2[has] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][has])
    return f1, f2


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n, f1, f2, bands, sketch) of each row; f1 and f2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, offsets = shingles(part.column(1))
                n = np.diff(offsets)
                has = n > 0
                starts = offsets[:-1][has]
                f1, f2 = set_names(sets, offsets)
                bands, sketch = np.zeros((0, BANDS), np.int64), np.zeros((0, SKETCH_BITS // 64), np.int64)
                if len(starts):
                    samples = signatures(sets, offsets)
                    bands, sketch = band_keys(samples), odd_sketches(samples)
                lists = []
                for table in (bands, sketch):
                    ends = np.zeros(len(n) + 1, dtype=np.int32)
                    np.cumsum(np.where(has, table.shape[1], 0), out=ends[1:])
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(table.ravel())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), *lists], names=["doc", "n", "f1", "f2", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.transform(map_arrow, run, "doc long, n long, f1 long, f2 long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, f1, shingles): full sets, as bytes, of the wanted (doc, f1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets, offsets = shingles(part.column(1))
                f1 = np.zeros(part.num_rows, np.uint64)
                has = np.diff(offsets) > 0
                if has.any():
                    with np.errstate(over="ignore"):
                        f1[has] = np.add.reduceat(mix64(sets), offsets[:-1][has])
                data = [sets[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(f1.view(np.int64)), pa.array(data, pa.binary())], names=["doc", "f1", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    some = rows.join(wanted.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi")
    made = some.transform(map_arrow, run, "doc long, f1 long, shingles binary")
    return made.join(wanted.hint("shuffle_hash"), ["doc", "f1"], "left_semi").dropDuplicates(["doc", "f1"])


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets (sorted, not empty) are similar enough."""
    small, large = (p, q) if len(p) < len(q) else (q, p)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= PERCENT * (len(p) + len(q) - both)


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                ok[i] = similar(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    met = pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
    return met.transform(map_arrow, run, "a long, b long")


def _odd_bits(x: str, y: str) -> Column:
    both = F.zip_with(F.col(x), F.col(y), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(both, F.lit(0), lambda s, v: s + v)


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sizes and Odd sketches allow the threshold."""
    one = reps.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    two = reps.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    met = pairs.join(one, "a").join(two, "b")
    sizes = (100 * F.least("na", "nb")) >= (PERCENT * F.greatest("na", "nb"))
    return met.where(sizes & (_odd_bits("ka", "kb") <= most_odd_bits())).select("a", "b")


def _full_sets(docs: DataFrame, reps: DataFrame, ends: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, f1, shingles) of all classes of the docs in ends (doc)."""
    wanted = reps.select("doc", "f1").join(ends.distinct(), "doc", "left_semi")
    return materialize(_sets(docs, materialize(wanted, "near-wanted"), id_col, text_col), "near-sets")


def _candidates(sketch: np.ndarray, bands: np.ndarray, n: np.ndarray, comp: np.ndarray, key: int, x: int, ys: np.ndarray) -> np.ndarray:
    """Those of ys that may link x to another component, and that meet x in this bucket first."""
    ys = ys[(comp[ys] != comp[x]) & (100 * np.minimum(n[ys], n[x]) >= PERCENT * np.maximum(n[ys], n[x]))]
    ys = ys[np.bitwise_count(sketch[ys] ^ sketch[x]).sum(axis=1) <= most_odd_bits()]
    same = bands[ys] == bands[x]
    return ys[bands[x][same.argmax(axis=1)] == key]


def _blocks_of(group: pa.Table) -> tuple[np.ndarray, ...]:
    columns = [group.column(c).to_numpy() for c in ("doc", "comp", "n", "part")]
    wide = [np.asarray(group.column(c).combine_chunks().flatten()).reshape(group.num_rows, -1) for c in ("sketch", "bands")]
    key, i, j = (group.column(c)[0].as_py() for c in ("key", "i", "j"))
    left, right = np.flatnonzero(columns[3] == i), np.flatnonzero(columns[3] == j)
    return (*columns, wide[0].view(np.uint64), wide[1], key, left, right, i == j)


def _may_link(spread: DataFrame) -> DataFrame:
    """The rows (key, i, j, part, doc, comp) of block pairs that have a candidate there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            doc, comp, n, _, sketch, bands, key, left, right, own = _blocks_of(group)
            some = np.zeros(len(doc), dtype=bool)
            for x in left.tolist():
                ys = _candidates(sketch, bands, n, comp, key, x, right[doc[right] > doc[x]] if own else right)
                some[ys] = True
                some[x] |= len(ys) > 0
            if some.any():
                yield from group.select(["key", "i", "j", "part", "doc", "comp"]).filter(pa.array(some)).combine_chunks().to_batches()

    return spread.transform(map_arrow, run, "key long, i int, j int, part int, doc long, comp long")


def _links(full: DataFrame) -> DataFrame:
    """(a, b): exact links of block pairs that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            doc, comp, n, _, sketch, bands, key, left, right, own = _blocks_of(group)
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in group.column("shingles").combine_chunks()]
            root = {c: c for c in comp.tolist()}

            def find(c: int) -> int:
                while root[c] != c:  # noqa: B023
                    root[c] = root[root[c]]  # noqa: B023
                    c = root[c]  # noqa: B023
                return c

            a, b = [], []
            for x in left.tolist():
                ys = _candidates(sketch, bands, n, comp, key, x, right[doc[right] > doc[x]] if own else right)
                ys = ys[np.argsort(np.bitwise_count(sketch[ys] ^ sketch[x]).sum(axis=1), kind="stable")]
                for y in ys.tolist():
                    p, q = find(int(comp[x])), find(int(comp[y]))
                    if p != q and similar(sets[x], sets[y]):
                        root[max(p, q)] = min(p, q)
                        a.append(doc[x])
                        b.append(doc[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return full.transform(map_arrow, run, "a long, b long").distinct()


BLOCK_KEY = ("key", "i", "j")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY).select(*BLOCK_KEY, "part", "doc", "comp", "n", "sketch", "bands", *columns)


def _compare_blocks(docs: DataFrame, members: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b): links between the components of members (key, doc, comp)."""
    known = reps.select("doc", "n", "sketch", "bands")
    sized = materialize(members.join(reps.select("doc", "n"), "doc").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("held")), "near-sizes")
    parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
    met = members.join(sized.hint("shuffle_hash"), "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = met.withColumn("other", other).select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc", "comp")
    some = materialize(_may_link(_dealt(spread.join(known, "doc"))), "near-may")
    sets = _full_sets(docs, reps, some.select("doc"), id_col, text_col)
    full = materialize(known.join(sets.select("doc", "shingles"), "doc"), "near-full")
    return materialize(_links(_dealt(some.join(full, "doc"), "shingles")), "near-links")


def link_classes(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, component) over classes that have a link."""
    doc = F.col("doc")
    rows = reps.select(F.explode("bands").alias("key"), "doc")
    by_hash = [F.min_by("doc", F.xxhash64("doc", F.lit(t))).alias(f"l{t}") for t in (1, 2)]
    seen = rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), *by_hash).where("lo < hi")
    members = materialize(rows.join(materialize(seen, "near-buckets").hint("shuffle_hash"), "key"), "near-members")
    lead = F.explode(F.array_distinct(F.array("lo", "hi", "l1", "l2")))
    pairs = members.select("doc", lead.alias("lead")).where("doc != lead").select(F.least("doc", "lead").alias("a"), F.greatest("doc", "lead").alias("b")).distinct()
    pairs = materialize(_plausible(pairs, reps), "near-pairs")
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc")))
    links = materialize(_confirm(pairs, _full_sets(docs, reps, ends, id_col, text_col)), "near-links")
    labels = materialize(components(links), "near-labels")

    of = members.select("key", "doc").join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    known = materialize(of.select("key", "doc", F.coalesce("component", doc).alias("comp")), "near-labelled")
    mixed = known.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x < y AND m > 3").select("key")
    still = materialize(known.join(materialize(mixed, "near-mixed").hint("shuffle_hash"), "key", "left_semi"), "near-open")
    if still.isEmpty():
        return labels
    more = _compare_blocks(docs, still, reps, id_col, text_col)
    if more.isEmpty():
        return labels
    return materialize(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), a row for each row of docs."""
    rows = materialize(features(docs, id_col, text_col), "near-features")
    live = rows.where("n > 0 AND doc IS NOT NULL")
    classes = materialize(live.groupBy("f1", "f2").agg(F.min("doc").alias("rep")), "near-classes")
    named = live.select("doc", "f1", "f2").distinct().join(classes.hint("shuffle_hash"), ["f1", "f2"])
    named = materialize(named.select("doc", "f1", "rep"), "near-named")
    # One row a class: where a doc_id occurs with several sets, each is its own class of that node.
    reps = rows.join(named.where("doc = rep").select("doc", "f1").hint("shuffle_hash"), ["doc", "f1"], "left_semi")
    reps = materialize(reps.dropDuplicates(["doc", "f1"]).select("doc", "n", "f1", "bands", "sketch"), "near-reps")
    labels = link_classes(docs, reps, id_col, text_col)
    of_class = named.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc", "rep", F.coalesce("component", "rep").alias("component"))
    # A doc_id with several texts joins their components; else every doc_id has one row here.
    several = materialize(of_class.groupBy("doc").agg(F.min("rep").alias("rep"), F.min("component").alias("component"), F.max("component").alias("other")), "near-docs")
    if not several.where("component != other").isEmpty():
        again = components(of_class.select(F.col("doc").alias("a"), F.col("component").alias("b")))
        several = several.select("doc", "rep").join(again.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    out = rows.select("doc", "n").join(several.select("doc", "rep", "component"), "doc", "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("rep", "doc").alias("class_id"), component.alias("component_id"), (F.col("doc").isNull() | (F.col("doc") == component)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the smallest document of each group of near duplicates.

    Of rows with the same id and set one stays. Rows with null id are documents of their own here, which
    come after all others.
    """
    named = _with_nodes(docs, id_col)
    found = near_duplicates(named, "_node", text_col)
    gone = materialize(found.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    kept = named.join(gone.withColumnRenamed("doc_id", "_gone_id"), F.col("_node") == F.col("_gone_id"), "left_anti")
    often = materialize(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_node")), "near-repeated")
    if often.isEmpty():
        return kept.select(*docs.columns)
    several = kept.join(often, "_node", "left_semi").select(*kept.columns)
    nth = F.row_number().over(Window.partitionBy("_node", "_f1", "_f2").orderBy(text_col, F.xxhash64(*docs.columns)))
    once = _with_set_names(several, text_col).withColumn("_nth", nth).where("_nth = 1")
    return kept.join(often, "_node", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def _with_nodes(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with _node: the id; for rows without one, numbers that are no row's id, the largest if they fit."""
    node = F.col(id_col).cast("long")
    named = docs.withColumn("_node", node)
    # Kept: at is another number in each run of a plan.
    orphans = materialize(docs.where(node.isNull()).withColumn("_at", F.monotonically_increasing_id()), "near-orphans")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = orphans.groupBy(part.alias("part")).count().orderBy("part").collect()
    if not parts:
        return named
    total = sum(r["count"] for r in parts)
    ends = docs.agg(F.min(node).alias("lo"), F.max(node).alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["hi"] is not None else (0, 0)
    start = hi + 1 if hi + total < 1 << 63 else lo - total
    if start < -(1 << 63):
        raise ValueError("no room beside the ids for rows without one")
    starts = []
    for r in parts:
        starts.append((r["part"], start))
        start += r["count"]
    first = docs.sparkSession.createDataFrame(starts, "_part long, _first long")
    numbered = orphans.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("_node", F.col("_first") + at)
    return named.where(node.isNotNull()).unionByName(numbered.select(*docs.columns, "_node"))


def _with_set_names(rows: DataFrame, text_col: str) -> DataFrame:
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                f1, f2 = set_names(*shingles(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], names=[*part.schema.names, "_f1", "_f2"])

    return rows.transform(map_arrow, run, StructType([*rows.schema.fields, StructField("_f1", LongType()), StructField("_f2", LongType())]))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN range(1, 2) ELSE range(0, 0) END) AS p FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * i >= 75 * (p.n + q.n - i)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS v, doc_id AS r FROM d UNION SELECT ways.y, reach.r FROM reach JOIN ways ON reach.v = ways.x
), least AS (
  SELECT v, min(r) AS component_id FROM reach GROUP BY v
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id, d.doc_id = least.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN least ON least.v = d.doc_id
"""
