"""Shared helpers: shared-folder tables, word hashing on Arrow buffers, Arrow slicing."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Words are maximal runs of bytes other than these (ASCII space and \t \n \v \f \r).
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Bytes of text handled at once inside a Python worker.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch between Spark and Python; each task holds a few.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("stratakv.llm.testDir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="stratakv-")
            spark.conf.set("stratakv.llm.testDir", root)
    return root.rstrip("/")


#: Tables written for the work that owned() has in hand.
_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a rerun of the reader's tasks, not of df. Inside owned() the
    table goes when the work is done; elsewhere it stays for the caller, for the result may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() has written, where nothing will read it again."""
    for t in tables:
        delete(t.sparkSession, t._written_at)


def owned(spark: SparkSession, label: str, work: Callable[[], DataFrame]) -> DataFrame:
    """What work() returns, as one table; all tables that it has written on the way are deleted.

    If it fails they stay, for whoever looks into the failure.
    """
    inner: list[str] = []
    before = _WRITTEN.set(inner)
    try:
        made = work()
    finally:
        _WRITTEN.reset(before)
    done = materialize(made, label)
    for path in inner:
        delete(spark, path)
    return done


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), with bounded batches, and with memory returned after each task.

    The bound lowers the session's setting where it is above; it never raises it. Workers live on
    between tasks, and what the allocators keep would count against the executor meanwhile.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = re.fullmatch(r"(\d+)b?", conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: str | None) -> list[str]:
    return [w for w in _SPACES.split(text) if w] if text else []


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds more than limit bytes of column (or one row)."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty), and the rows' offsets into them."""
    large = column.cast(pa.large_string()).fill_null("")
    if isinstance(large, pa.ChunkedArray):
        large = large.combine_chunks()
    n, first = len(large), large.offset
    offsets = np.frombuffer(large.buffers()[1], dtype=np.int64)[first : first + n + 1]
    data = large.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed odd uint64 numbers that depend on seed alone."""
    base = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return mix64(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) < n:
        base = int(randoms(seed, 1)[0])
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        have = _POWERS[seed] = (out[0], out[1])
    return have


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words: (hash, start, end, row offsets into the words).

    A word's hash is a polynomial over its bytes, each sent through a random table first, taken
    from prefix sums, so that no word is handled one by one.
    """
    n = len(raw)
    blank = np.zeros(256, dtype=bool)
    blank[list(SPACE_BYTES)] = True
    inside = ~blank[raw]
    # A row's end also ends a word.
    first = np.empty(n, dtype=bool)
    last = np.empty(n, dtype=bool)
    if n:
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first[0], first[1:] = inside[0], inside[1:] & ~inside[:-1]
        first |= inside & edge[:-1]
        last[-1], last[:-1] = inside[-1], inside[:-1] & ~inside[1:]
        last |= inside & edge[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    codes = randoms(seed + 1000, 256)
    if lower:
        codes[65:91] = codes[97:123]
    up, down = _powers(seed, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[raw] * up[:n], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(words: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums s and powers d such that (s[b] - s[a]) * d[a] is a polynomial over words[a:b]."""
    up, down = _powers(seed, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words * up[: len(words)], out=sums[1:])
    return sums, down


def window_hashes(words: np.ndarray, bounds: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside rows, and the rows' offsets into them."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    sums, down = prefix_sums(words, seed)
    with np.errstate(over="ignore"):
        at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], counts)
        return mix64((sums[at + k] - sums[at]) * down[at]), out


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by its first n_keys (integer) columns.

    Holds one group and one batch at a time.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if held is not None:
            now = pa.concat_tables([held, now]).combine_chunks()
        change = np.zeros(now.num_rows - 1, dtype=bool)
        for i in range(n_keys):
            key = now.column(i).to_numpy()
            change |= key[1:] != key[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield now.slice(a, b - a)
        held = now.slice(cuts[-1])
    if held is not None:
        yield held
