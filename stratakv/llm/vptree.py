"""Approximate nearest neighbours by cosine: one vantage-point tree per shard.

Vectors are scaled to length one; the distance between them is the chord, a metric that ranks as the
cosine does. A tree splits its vectors at the median distance from a vantage point (of a few tried,
the one whose distances spread most), and keeps for both halves the smallest and largest of these
distances. By the triangle inequality a half cannot hold anything nearer than `lack`, the amount by
which the query's distance from the vantage point misses the half's interval. A half is skipped if
lack * factor exceeds the distance of the k-th best so far. Factor one skips nothing that could count
and so gives exact results; larger factors skip more. Queries descend in blocks: a node serves all
queries that reach it at once.

How much a factor skips, and loses, depends on the vectors: where they have structure a small one
skips most of a tree, where they have none only a large one skips anything. So the vectors of each length bring their own
factor: the largest of `FACTORS` that finds `RECALL` of the neighbours of some rows in each of the first
`CALIBRATED` trees (shards are alike, for they are dealt by hash). Callers may give a factor instead, 1 for
exact results.

Scores are the cosine of the original vectors in double precision, computed by one fixed summation
order, so equal vectors have equal scores; ties go to the smaller id. Vectors are scaled by a power of
two first, which changes no digit, so very small and very large ones neither vanish nor overflow.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, neither do rows with null id; queries meet the vectors of their own length, each length having
its own trees; with fewer than k candidates all are returned; rows that repeat an id are candidates of
their own, and only rows with the query's own id are left out; queries that repeat an id with another
vector have results of their own, those that repeat both have one; no queries or an empty table give
an empty result.

Plan: rows fall into shards by length and hash, as many as fit in `SHARD_BYTES`, so no value of any
column makes a shard large. A shard's tree is built once and written to the shared folder as one row.
Queries are packed into blocks of `QUERY_BLOCK`; blocks and trees are dealt by (length, shard, group),
a group being `GROUP` blocks, and the tree is sent once for each group: the stated query set against
all rows, in blocks. A task holds one tree and one block. Each pair returns at most k rows a query, and
the best k are taken after a limit inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups, map_arrow, materialize

#: Bytes of a shard's vectors, and the rows that it has at most.
SHARD_BYTES, SHARD_ROWS = 16 << 20, 8192
QUERY_BLOCK = 1024
#: Blocks that share one copy of a tree.
GROUP = 64
LEAF = 128
#: Factors tried, the recall that the chosen one reaches, the rows it is tried with in a tree, and the trees.
FACTORS = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0)
RECALL, TRIED, CALIBRATED = 0.98, 48, 4
#: Most shard and group pairs that are dealt to partitions of their own.
MOST_PARTITIONS = 20_000
#: Rounding in distances stays far below this.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Vectors that have a direction."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row by a power of two, so that its largest component is between 1/2 and 1; no digit changes."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; each row's result depends on that row alone. Rows are scaled()."""
    dot = np.add.reduce(a * b, axis=-1)
    return dot / (np.sqrt(np.add.reduce(a * a, axis=-1)) * np.sqrt(np.add.reduce(b * b, axis=-1)))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one, of rows that are scaled()."""
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Tree:
    """Nodes in arrays: vantage row, the halves' first nodes, intervals; leaves are runs of rows."""

    def __init__(self, unit_rows: np.ndarray, seed: int = 0):
        self.rows = unit_rows
        self.order = np.arange(len(unit_rows))
        #: start, end, vantage row or -1, near node, far node
        self.nodes: list[list[int]] = []
        self.spans: list[tuple[float, float, float, float]] = []
        rng = np.random.default_rng(seed)
        if len(unit_rows):
            self._build(0, len(unit_rows), rng)

    def _build(self, start: int, end: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append([start, end, -1, -1, -1])
        self.spans.append((0.0, 0.0, 0.0, 0.0))
        if end - start > LEAF:
            members = self.order[start:end]
            # The vantage point is the one of a few whose distances spread most.
            tries = rng.choice(members, size=5, replace=False)
            probe = rng.choice(members, size=min(len(members), 64), replace=False)
            spread = [chord(self.rows[probe], self.rows[t]).std() for t in tries]
            vantage = int(tries[int(np.argmax(spread))])
            d = chord(self.rows[members], self.rows[vantage])
            half = len(members) // 2
            by = np.argpartition(d, half)
            near, far = by[:half], by[half:]
            self.order[start:end] = members[np.concatenate([near, far])]
            self.spans[at] = (d[near].min(), d[near].max(), d[far].min(), d[far].max())
            self.nodes[at][2] = vantage
            self.nodes[at][3] = self._build(start, start + half, rng)
            self.nodes[at][4] = self._build(start + half, end, rng)
        return at


def chord(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (rows @ point), 0))


class Best:
    """The k best candidates of each query of a block, by (score down, id up)."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def radius(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.maximum(self.score[q, -1], -3), 0))

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.score[q], scores]), np.concatenate([self.id[q], ids])
        best = np.lexsort((i, -s))[: self.score.shape[1]]
        self.score[q], self.id[q] = s[best], i[best]


def search(tree: Tree, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float) -> tuple[Best, int]:
    """Best k of the tree's rows for each query, and how many distances it took."""
    best, unit_queries, seen = Best(len(queries), k), unit(queries), 0

    def visit(node: int, active: np.ndarray) -> None:
        nonlocal seen
        start, end, vantage, near, far = tree.nodes[node]
        if vantage < 0:
            members = tree.order[start:end]
            rough = unit_queries[active] @ tree.rows[members].T
            seen += rough.size
            may = rough >= best.score[active, -1][:, None] - SLACK
            may &= ids[members][None, :] != query_ids[active][:, None]
            if may.shape[1] > k:
                # Only the leaf's own k best (and ties) can enter.
                kth = np.partition(np.where(may, rough, -np.inf), may.shape[1] - k, axis=1)[:, -k]
                may &= rough >= kth[:, None] - SLACK
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                chosen = members[may[i]]
                best.offer(active[i], cosines(np.broadcast_to(queries[active[i]], (len(chosen), queries.shape[1])), rows[chosen]), ids[chosen])
            return
        d = chord(unit_queries[active], tree.rows[vantage])
        seen += len(active)
        low_n, high_n, low_f, high_f = tree.spans[node]
        lack_n = np.maximum(np.maximum(low_n - d, d - high_n), 0)
        lack_f = np.maximum(np.maximum(low_f - d, d - high_f), 0)
        near_first = lack_n <= lack_f
        for child, lack, mask in ((near, lack_n, near_first), (far, lack_f, ~near_first), (far, lack_f, near_first), (near, lack_n, ~near_first)):
            # The last two turns are the second halves, by then with smaller radii.
            go = mask & (lack * factor <= best.radius(active) + SLACK)
            if go.any():
                visit(child, active[go])

    if tree.nodes:
        visit(0, np.arange(len(queries)))
    return best, seen


def choose_factor(tree: Tree, rows: np.ndarray, k: int, seed: int) -> float:
    """The largest of FACTORS that finds RECALL of the k nearest of some of the tree's own rows."""
    if len(rows) <= LEAF:
        return FACTORS[0]
    ids = np.arange(len(rows))
    asked = np.random.default_rng(seed).choice(ids, size=min(TRIED, len(ids)), replace=False)
    exact, _ = search(tree, rows, ids, rows[asked], asked, k, FACTORS[0])
    low, high = 0, len(FACTORS) - 1
    while low < high:
        middle = (low + high + 1) // 2
        found, _ = search(tree, rows, ids, rows[asked], asked, k, FACTORS[middle])
        # By score: of equally near rows any will do.
        if (found.score >= exact.score - SLACK).mean() >= RECALL:
            low = middle
        else:
            high = middle - 1
    return FACTORS[low]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull())
    return rows.where(usable(F.col("v"))).withColumn("d", F.size("v"))


TREE = "d int, shard int, factor double, n int, nodes binary, spans binary, ids binary, data binary"


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, k: int = 5) -> DataFrame:
    """One row a tree: (d, shard, factor, n, ...). Every usable row is in one shard's tree of its length d.

    The first trees of a length have a factor; the length's is their smallest.
    """
    rows = materialize(_valid(vectors, id_col, vector_col), "vp-rows")
    per = F.greatest(F.lit(1), F.least(F.lit(shard_rows), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("d")))))
    lengths = materialize(rows.groupBy("d").agg(F.count("*").alias("n")).select("d", F.ceil(F.col("n") / per).cast("int").alias("shards")), "vp-lengths")
    dealt = rows.join(lengths, "d").withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.col("shards")).cast("int")).select("d", "shard", "id", "v")
    total = lengths.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(min(total, MOST_PARTITIONS), "d", "shard").sortWithinPartitions("d", "shard", "id", F.xxhash64("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            d, shard = (group.column(c)[0].as_py() for c in ("d", "shard"))
            data, ids = scaled(_matrix(group.column("v"))), group.column("id").to_numpy()
            tree = Tree(unit(data), seed=shard)
            factor = choose_factor(tree, data, k, shard) if shard < CALIBRATED else None
            order = tree.order
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            nodes = np.array(tree.nodes, dtype=np.int64)
            inner = nodes[:, 2] >= 0
            nodes[inner, 2] = place[nodes[inner, 2]]
            parts = [nodes.tobytes(), np.array(tree.spans).tobytes(), ids[order].tobytes(), data[order].tobytes()]
            names = ["d", "shard", "factor", "n", "nodes", "spans", "ids", "data"]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([shard], pa.int32()), pa.array([factor], pa.float64()), pa.array([order.size], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=names)

    return materialize(dealt.transform(map_arrow, run, TREE), "vp-trees")


def _load(row: dict) -> tuple[Tree, np.ndarray, np.ndarray]:
    n = row["n"]
    data = np.frombuffer(row["data"]).reshape(n, -1)
    tree = Tree(np.zeros((0, data.shape[1])))
    tree.rows, tree.order = unit(data), np.arange(n)
    tree.nodes = np.frombuffer(row["nodes"], dtype=np.int64).reshape(-1, 5).tolist()
    tree.spans = [tuple(s) for s in np.frombuffer(row["spans"]).reshape(-1, 4).tolist()]
    return tree, np.frombuffer(row["ids"], dtype=np.int64), data


def nearest(trees: DataFrame, queries: DataFrame, k: int = 5, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, itself left out.

    factor: None for the one that the trees of a length have chosen.
    """
    asked = materialize(_valid(queries, id_col, vector_col).withColumn("mark", F.xxhash64("v")).dropDuplicates(["id", "v"]), "vp-queries")
    blocks = materialize(asked.groupBy("d").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "vp-blocks")
    named = asked.join(blocks, "d").withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks")).cast("int"))
    packed = named.repartition("d", "block").sortWithinPartitions("d", "block", "id", "mark").select("d", "block", "id", "mark", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 2):
            d, number = (group.column(c)[0].as_py() for c in ("d", "block"))
            parts = [group.column("id").to_numpy().tobytes(), group.column("mark").to_numpy().tobytes(), scaled(_matrix(group.column("v"))).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([number], pa.int32()), *[pa.array([p], pa.binary()) for p in parts]], names=["d", "block", "ids", "marks", "data"])

    packs = packed.transform(map_arrow, pack, "d int, block int, ids binary, marks binary, data binary")
    packs = materialize(packs.withColumn("grp", F.floor(F.col("block") / GROUP).cast("int")), "vp-packs")
    met = packs.select("d", "grp").distinct().join(trees.select("d", "shard"), "d")
    met = materialize(met.groupBy("d", "shard", "grp").count().drop("count"), "vp-met")
    none = F.lit(None).cast("binary")
    chosen = materialize(trees.groupBy("d").agg(F.coalesce(F.min("factor"), F.lit(FACTORS[0])).alias("factor")), "vp-factors")
    one = trees.drop("factor").join(met, ["d", "shard"]).join(chosen, "d").select("d", "shard", "grp", F.lit(0).alias("kind"), "factor", "n", "nodes", "spans", "ids", none.alias("marks"), "data")
    two = packs.join(met, ["d", "grp"]).select("d", "shard", "grp", F.lit(1).alias("kind"), F.lit(0.0).alias("factor"), F.lit(0).alias("n"), none.alias("nodes"), none.alias("spans"), "ids", "marks", "data")
    # The tree of a (length, shard, group) comes first, then its blocks, one at a time.
    key = ["d", "shard", "grp"]
    dealt = one.unionByName(two).repartition(max(1, min(met.count(), MOST_PARTITIONS)), *key).sortWithinPartitions(*key, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, own = None, 1.0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("d", "kind", "factor", "n", "nodes", "spans", "ids", "marks", "data")}
                if row["kind"] == 0:
                    loaded, own = _load(row), row["factor"]
                    continue
                tree, ids, data = loaded
                qids, marks = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["marks"], dtype=np.int64)
                best, _ = search(tree, data, ids, np.frombuffer(row["data"]).reshape(len(qids), -1), qids, k, own if factor is None else factor)
                found = np.isfinite(best.score)
                each = found.sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, each)), pa.array(np.repeat(marks, each)), pa.array(best.id[found]), pa.array(best.score[found])], names=["query_id", "mark", "vec_id", "score"])

    found = dealt.transform(map_arrow, run, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found."""
    keys = ["query_id", "vec_id"]
    return found.select(*keys).join(exact.select(*keys), keys, "left_semi").count() / max(1, exact.count())


def search_table(vectors: DataFrame, every: int = 50, k: int = 5, factor: float | None = None) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by every."""
    return nearest(build(vectors, k=k), vectors.where(F.col("vec_id") % every == 0), k, factor)


#: The five nearest without loss, as factor one finds them; scores to nine digits.
EXACT_ORACLE = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, nth::INTEGER AS rank, vec_id, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS nth FROM s) WHERE nth <= 5
"""
