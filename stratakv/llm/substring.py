"""Substring dedup on a de Bruijn graph of token k-mers.

An edge of the graph is a run of `k` consecutive words (its nodes are the runs of k - 1 words at
either end). The source of an edge is the smallest document in which it starts. In a document every
edge whose source is a smaller document is to go, with all its words.

Anchors. Each edge has an anchor, the smallest hash among its runs of `anchor` words, which equal
edges share. Consecutive edges of a text with one anchor are one unit, as minimisers group k-mers where
de Bruijn graphs are compacted in parallel: the cuts depend on the words alone, so a passage that two
documents share falls into the same units but for its ends. A unit whose anchor occurs in one document
only has no repeated edge. Units of two documents or more are repeated as a whole; of these the source's
copy, and all units that are not repeated as a whole, are opened into edges, which are units of their own
if two documents or more have them.

Compaction. Units follow one another in texts. At the node between two units the graph does not branch
if the first has out-degree one and the second in-degree one, over all their occurrences, the end of a
text or of the repeated part counting as a branch. Such units are joined, by pointer doubling: in each
round every unit joins the unit at its pointer, so paths of n units take log2(n) joins. All occurrences
of a nonbranching path run through the whole of it, so it has one source, and each of its occurrences in
a later document is one span with the source's coordinates. Neighbouring spans with the same shift to
the same source merge.

Verification. Names of units are hashes of `name_bits` bits. Each span's words, all of them, are compared
with the words at its source's coordinates, by their SHA-256, in the pass that removes them. If any
differ, names have collided, and the whole search is done again with other hashes of twice the bits: what
is returned has always been verified, and as equal words have equal names nothing is missed.

Defined results: null text has no words; rows with null doc_id take no part and stay; rows with the
same doc_id are one document for the comparison and are told apart by a hash of their text; fewer
than k words: nothing goes. Kept words are joined by one blank. Texts of any length are handled
whole. An empty table gives an empty result. Other columns are not read.

Plan: three passes over texts (units; edges of opened units; removal), each one narrow Python pass. A hot
passage costs one partial row a task where minima and degrees are made, and the joins back are plain
shuffled joins whose hot partitions can be split. Nothing is broadcast or gathered; a window orders the
units of one document at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, mix64, prefix_sums, slices, text_bytes, window_hashes, word_hashes, words_of

K, ANCHOR = 50, 16
NAME_BITS, ATTEMPTS = 96, 5
SEED_WORD, SEED_ANCHOR, SEED_EDGE, SEED_CHECK = 1, 21, 22, 23
#: Between the seeds of one attempt and the next.
SEED_STEP = 1000


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        gap = width - span
        out = np.minimum(out[:-gap], out[gap:])
    return out


class Runs:
    """Names of runs of words in a slice of documents."""

    def __init__(self, texts: pa.Array, attempt: int, bits: int):
        self.attempt, self.bits = attempt * SEED_STEP, bits
        self.words, _, _, self.bounds = word_hashes(*text_bytes(texts), lower=False, seed=SEED_WORD + self.attempt)

    def units(self, k: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, number of edges, anchor) of each run of edges with one anchor."""
        counts = np.maximum(np.diff(self.bounds) - k + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        first = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=first[1:])
        at = np.arange(first[-1]) + np.repeat(self.bounds[:-1] - first[:-1], counts)
        if not len(at):
            return at, at, at, at
        runs, _ = window_hashes(self.words, np.array([0, len(self.words)]), anchor, SEED_ANCHOR + self.attempt)
        anchors = sliding_min(runs, k - anchor + 1)[at].view(np.int64)
        change = np.ones(len(at), dtype=bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(change)
        return row[begin], at[begin], np.diff(np.append(begin, len(at))), anchors[begin]

    def names(self, at: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Names of runs of words, by start and length: 64 bits and 32 bits, or fewer."""
        out = []
        with np.errstate(over="ignore"):
            for seed in (SEED_EDGE, SEED_CHECK):
                sums, down = prefix_sums(self.words, seed + self.attempt)
                out.append(mix64((sums[at + length] - sums[at]) * down[at] + np.asarray(length).astype(np.uint64)))
        low, high = min(self.bits, 64), max(self.bits - 64, 0)
        c2 = (out[1] >> np.uint64(64 - high)).astype(np.uint32) if high else np.zeros(len(out[1]), np.uint32)
        # However few the bits, names of runs of different lengths differ.
        return (out[0] >> np.uint64(64 - low)).view(np.int64), (c2 ^ np.asarray(length).astype(np.uint32)).view(np.int32)


def _read(docs: DataFrame, id_col: str, text_col: str, attempt: int) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text, F.lit(attempt)).bitwiseAND(F.lit(0x7FFFFFFF)).alias("mark"), text.alias("text"))


def _units(live: DataFrame, k: int, anchor: int, attempt: int, bits: int) -> DataFrame:
    """(anchor, n, c1, c2, doc, place) of all units; place: mark and first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs = Runs(part.column(2), attempt, bits)
                row, at, n, anchors = runs.units(k, anchor)
                c1, c2 = runs.names(at, n + (k - 1))
                place = (np.asarray(part.column(1))[row] << 32) | (at - runs.bounds[row])
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n.astype(np.int32)), pa.array(c1), pa.array(c2), part.column(0).take(pa.array(row)), pa.array(place)], names=["anchor", "n", "c1", "c2", "doc", "place"])

    return live.transform(map_arrow, run, "anchor long, n int, c1 long, c2 int, doc long, place long")


def _edges(live: DataFrame, opened: DataFrame, k: int, attempt: int, bits: int) -> DataFrame:
    """(n, c1, c2, doc, place): the edges of the opened units (doc, place, n); n is 1.

    c2 has its top bit turned, so that an edge and a unit of one edge have names of their own.
    """
    mark, start = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    lists = opened.select("doc", mark.alias("mark"), F.struct(start.alias("start"), "n").alias("u")).groupBy("doc", "mark").agg(F.collect_set("u").alias("units"))
    # Rows with one id and text are one text.
    texts = live.join(lists.hint("shuffle_hash"), ["doc", "mark"]).select("doc", "mark", "text", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                runs, lists = Runs(part.column(2), attempt, bits), part.column(3)
                flat = lists.flatten()
                first, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                ends = np.cumsum(n)
                inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
                row, start = np.repeat(row, n), np.repeat(first, n) + inside
                c1, c2 = runs.names(runs.bounds[row] + start, k)
                place = (np.asarray(part.column(1))[row] << 32) | start
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(row), np.int32)), pa.array(c1), pa.array(c2 ^ np.int32(-(1 << 31))), part.column(0).take(pa.array(row)), pa.array(place)], names=["n", "c1", "c2", "doc", "place"])

    return texts.transform(map_arrow, run, "n int, c1 long, c2 int, doc long, place long")


NAME = ["c1", "c2"]


def _repeated(units: DataFrame) -> DataFrame:
    """(c1, c2, source) of the units that two documents or more have."""
    seen = units.groupBy(*NAME).agg(F.min("doc").alias("source"), F.max("doc").alias("last"))
    return seen.where("source < last").drop("last")


def compact(units: DataFrame) -> DataFrame:
    """units: all occurrences (layer, n, c1, c2, doc, place, source).

    (c1, c2, length, source, source_place): the first unit of each maximal nonbranching path, the path's
    edges, and where the source has it.
    """
    text = Window.partitionBy("layer", "doc", F.shiftright("place", 32)).orderBy("place")
    sides = units
    for side, step, touches in (("next", F.lead, F.col("place") + F.col("n") == F.lead("place").over(text)), ("prev", F.lag, F.lag("place").over(text) + F.lag("n").over(text) == F.col("place"))):
        for c in NAME:
            sides = sides.withColumn(f"{side}_{c}", F.when(touches, step(c).over(text)))
    ends = [f(f"{side}_{c}").alias(f"{f.__name__}_{side}_{c}") for side in ("next", "prev") for c in NAME for f in (F.min, F.max)]
    known = [F.count(f"{side}_c1").alias(f"n_{side}") for side in ("next", "prev")]
    first = F.min(F.when(F.col("doc") == F.col("source"), F.col("place"))).alias("source_place")
    named = sides.groupBy(*NAME).agg(F.count("*").alias("all"), *known, *ends, F.min("n").alias("n"), F.min("source").alias("source"), first)
    # Degree one: every occurrence has a neighbour there, and always the same.
    one = lambda side: (F.col(f"n_{side}") == F.col("all")) & F.expr(" AND ".join(f"min_{side}_{c} = max_{side}_{c}" for c in NAME))
    far = [f"to_{c}" for c in NAME]
    nodes = named.select(*NAME, "n", "source", "source_place", one("next").alias("goes"), one("prev").alias("comes"), *[F.col(f"min_next_{c}").alias(f"to_{c}") for c in NAME])
    nodes = materialize(nodes, "substring-nodes")
    after = nodes.where("comes").select(*[F.col(c).alias(f"to_{c}") for c in NAME], F.col("source").alias("s"), F.col("source_place").alias("p"))
    links = nodes.where("goes").join(after, far)
    links = materialize(links.where("s = source AND p = source_place + n").select(*NAME, *far), "substring-links")
    inner = links.select(*[F.col(f"to_{c}").alias(c) for c in NAME]).withColumn("inner", F.lit(True))
    paths = nodes.select(*NAME, "n").join(links, NAME, "left").join(inner, NAME, "left")
    paths = paths.select(*NAME, F.col("n").cast("long").alias("length"), F.col("inner").isNull().alias("head"), *far)
    done, left = [], materialize(paths, "substring-jumps")
    while True:
        # Heads whose path is at its end are done; what is inside a path stays, for others to jump to.
        done.append(left.where("head AND to_c1 IS NULL").select(*NAME, "length"))
        left = left.where("NOT head OR to_c1 IS NOT NULL")
        if left.where("head").isEmpty():
            break
        there = left.select(*[F.col(c).alias(f"to_{c}") for c in NAME], F.col("length").alias("more"), *[F.col(f"to_{c}").alias(f"far_{c}") for c in NAME])
        jumped = left.join(there, far, "left")
        left = materialize(jumped.select(*NAME, (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), "head", *[F.col(f"far_{c}").alias(f"to_{c}") for c in NAME]), "substring-jumps")
    heads = reduce(DataFrame.unionByName, done)
    return heads.join(nodes.select(*NAME, "source", "source_place"), NAME)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR, attempt: int = 0, name_bits: int = NAME_BITS) -> DataFrame:
    """(doc, mark, start, n_words, source_doc, source_mark, source_start): spans that smaller documents hold,
    by names; dedup() verifies them. Spans of different sources may overlap."""
    live = _read(docs, id_col, text_col, attempt).where("doc IS NOT NULL AND text IS NOT NULL")
    units = materialize(_units(live, k, anchor, attempt, name_bits), "substring-units")
    shared = units.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    every, units = units, materialize(units.join(shared.hint("shuffle_hash"), "anchor", "left_semi").drop("anchor"), "substring-shared")
    discard(every)
    whole = materialize(_repeated(units), "substring-whole")
    met = materialize(units.join(whole.hint("shuffle_hash"), NAME, "left"), "substring-met")
    opened = met.where("source IS NULL OR doc = source").select("doc", "place", "n")
    edges = materialize(_edges(live, opened, k, attempt, name_bits), "substring-edges")
    single = edges.join(materialize(_repeated(edges), "substring-single").hint("shuffle_hash"), NAME)

    both = met.where("source IS NOT NULL").withColumn("layer", F.lit(0)).unionByName(single.withColumn("layer", F.lit(1)))
    both = materialize(both.select("layer", "n", *NAME, "doc", "place", "source"), "substring-both")
    # Only the occurrences of repeated units are read from here on.
    discard(edges, met, units)
    paths = materialize(compact(both), "substring-paths")
    spans = both.where("doc > source").select(*NAME, "doc", "place").join(paths.hint("shuffle_hash"), NAME).select("doc", "place", "length", "source", "source_place")
    word = F.lit(0xFFFFFFFF)
    spans = spans.select("doc", F.shiftright("place", 32).alias("mark"), F.col("place").bitwiseAND(word).alias("start"), "length", "source", F.shiftright("source_place", 32).alias("source_mark"), F.col("source_place").bitwiseAND(word).alias("source_start"))
    same = ["doc", "mark", "source", "source_mark", "shift"]
    order = Window.partitionBy(*same).orderBy("start", "length")
    reach = F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = spans.withColumn("shift", F.col("source_start") - F.col("start")).withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    numbered = cut.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*same, "span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"))
    return merged.select("doc", "mark", "start", (F.col("end") - F.col("start") + (k - 1)).alias("n_words"), F.col("source").alias("source_doc"), "source_mark", (F.col("start") + F.col("shift")).alias("source_start"))


PROOF = "array<struct<start:bigint,n_words:bigint,words:binary>>"


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", attempt: int = 0) -> DataFrame:
    """(id, mark, n_words, n_removed, kept, own, asked): kept is the text's other words joined by one blank.

    own and asked: SHA-256 of the words of the document's spans, and of those that others have it as source of.
    """
    piece = F.struct("start", "n_words")
    own = spans.groupBy("doc", "mark").agg(F.collect_set(piece).alias("own"))
    source = spans.select(F.col("source_doc").alias("doc"), F.col("source_mark").alias("mark"), F.col("source_start").alias("start"), "n_words")
    asked = source.groupBy("doc", "mark").agg(F.collect_set(piece).alias("asked"))
    wanted = own.join(asked, ["doc", "mark"], "full")
    met = _read(docs, id_col, text_col, attempt).join(wanted.hint("shuffle_hash"), ["doc", "mark"], "left").select("doc", "mark", "text", "own", "asked")

    def digests(words: list[str], pieces: list[dict] | None) -> list[dict]:
        return [{**p, "words": hashlib.sha256(" ".join(words[p["start"] : p["start"] + p["n_words"]]).encode()).digest()} for p in pieces or ()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proof = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary())]))
        for batch in batches:
            for part in slices(batch, "text"):
                out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept", "own", "asked")}
                for text, own, asked in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    words = words_of(text)
                    out["own"].append(digests(words, own))
                    out["asked"].append(digests(words, asked))
                    out["n_words"].append(len(words))
                    if own:
                        keep = np.ones(len(words), dtype=bool)
                        for s in own:
                            keep[s["start"] : s["start"] + s["n_words"]] = False
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    out["n_removed"].append(out["n_words"][-1] - len(words))
                    out["kept"].append(" ".join(words))
                types = [pa.int64(), pa.int64(), pa.string(), proof, proof]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]], names=["id", "mark", *out])

    return met.transform(map_arrow, run, f"id long, mark long, n_words long, n_removed long, kept string, own {PROOF}, asked {PROOF}")


def unproven(spans: DataFrame, removed: DataFrame) -> DataFrame:
    """The sources whose words are not those of every span that names them."""
    at = ["source_doc", "source_mark", "source_start", "n_words"]
    mine = removed.select(F.col("id").alias("doc"), "mark", F.explode("own").alias("p")).select("doc", "mark", F.col("p.start").alias("start"), F.col("p.n_words").alias("n_words"), F.col("p.words").alias("words"))
    found = spans.join(mine, ["doc", "mark", "start", "n_words"], "left").groupBy(*at).agg(F.min("words").alias("a"), F.max("words").alias("b"), F.count_if(F.col("words").isNull()).alias("lost"))
    theirs = removed.select(F.col("id").alias("source_doc"), F.col("mark").alias("source_mark"), F.explode("asked").alias("p")).select("source_doc", "source_mark", F.col("p.start").alias("source_start"), F.col("p.n_words").alias("n_words"), F.col("p.words").alias("words"))
    theirs = theirs.groupBy(*at).agg(F.min("words").alias("c"), F.max("words").alias("d"))
    same = F.expr("lost = 0 AND a = b AND c = d AND a = c")
    return found.join(theirs, at, "left").where(~F.coalesce(same, F.lit(False)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, anchor: int = ANCHOR, name_bits: int = NAME_BITS) -> DataFrame:
    """(id, n_words, n_removed, kept), every removed span verified at its source's coordinates."""
    for attempt in range(ATTEMPTS):
        spans = materialize(repeated_spans(docs, id_col, text_col, k, anchor, attempt, min(NAME_BITS, name_bits << attempt)), "substring-spans")
        removed = materialize(remove_spans(docs, spans, id_col, text_col, attempt), "substring-kept")
        if unproven(spans, removed).isEmpty():
            return removed.select("id", "n_words", "n_removed", "kept")
    raise ArithmeticError(f"names of runs of words collided in {ATTEMPTS} attempts")


def report(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p:p + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), late AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id
), covered AS (
  SELECT DISTINCT doc_id, p + k AS i FROM late, (SELECT unnest(range(0, 50)) AS k)
), gone AS (
  SELECT doc_id, list(i) AS l, count(*) AS n FROM covered GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN l IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(l, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
