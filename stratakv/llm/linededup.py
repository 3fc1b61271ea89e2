"""Line dedup by overlapping three-line windows, in DataFrame functions only.

A window is `width` consecutive lines of one document (lines end at a newline). Windows are
ordered by (doc_id, text hash, position), nulls first. Every window whose lines have occurred in an
earlier window is a later occurrence; a line goes if any later occurrence covers it. Windows are
judged on the input. Lines that stay are joined by newlines.

Defined results: null text stays null (0 lines, none removed); a text with fewer lines than the
width has no window and stays; an empty text is one empty line; null doc_id sorts first. Rows that
agree in doc_id and text are one occurrence: they are judged alike, by the first other one. A text
all of whose lines go becomes the empty string. Extra columns pass through and never clash.

Plan: one narrow pass makes (window hash, document, position) rows; the count and the first
occurrence of each hash are aggregated before the shuffle, so a window in a third of all documents
costs one row a task; only hashes that occur twice or more are written out and joined back, as a
plain shuffled join that can split a hot hash. Positions are gathered per document, and one
document's lines are bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: 128 bits name a window: two hashes of the same lines under different leading salts.
SALTS = (11, 29)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (h1, h2, doc, thash, pos) of all windows; thash tells apart rows with the same id.

    The lines, and the lines from the 2nd, 3rd... on, side by side; rows without a last line go.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    lines = lines_of(F.col("text"))
    beside = F.arrays_zip(*[(lines if k == 0 else F.slice(lines, k + 1, F.size(lines))).alias(f"x{k}") for k in range(width)])
    each = base.select("doc", F.xxhash64("text").alias("thash"), F.posexplode(beside).alias("pos", "w")).where(F.col(f"w.x{width - 1}").isNotNull())
    names = [F.xxhash64(F.lit(salt), *[F.col(f"w.x{k}") for k in range(width)]).alias(f"h{i + 1}") for i, salt in enumerate(SALTS)]
    return each.select(*names, "doc", "thash", "pos")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc, thash, covered): the lines that go, in each document that has any."""
    windows = _windows(docs, id_col, text_col, width)
    place = F.struct("doc", "thash", "pos")
    seen = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(seen.where("first != last").select("h1", "h2", "first"), "line-windows")
    found = windows.join(repeated.hint("shuffle_hash"), ["h1", "h2"])
    later = found.where(~F.struct("doc", "thash", "pos").eqNullSafe(F.col("first")))
    lines = later.select("doc", "thash", F.explode(F.sequence("pos", F.col("pos") + (width - 1))).alias("line"))
    return lines.groupBy("doc", "thash").agg(F.collect_set("line").alias("covered"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """docs with the text's repeated lines removed, and two columns more: _n_lines, _n_removed (long)."""
    hits = covered_lines(docs, id_col, text_col, width).select(F.col("doc").alias("_hit_doc"), F.col("thash").alias("_hit_text"), F.col("covered").alias("_covered"))
    text = F.col(text_col)
    # The text travels as its lines, which are then a plain column: what follows splits nothing again.
    keyed = docs.select(*[lines_of(text).alias("_lines") if c == text_col else F.col(c) for c in docs.columns], F.xxhash64(text).alias("_thash"), text.isNotNull().alias("_known"))
    marked = keyed.join(hits.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_hit_doc")) & (F.col("_thash") == F.col("_hit_text")) & F.col("_known"), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_covered"))
    kept = F.when(F.col("_covered").isNull(), F.col("_lines")).otherwise(F.transform(stay, lambda i: F.get("_lines", i)))
    n_lines = F.when(F.col("_known"), F.size("_lines")).otherwise(0).cast("long")
    n_removed = F.when(F.col("_covered").isNull(), 0).otherwise(F.size("_covered")).cast("long")
    return marked.select(*[F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns], n_lines.alias("_n_lines"), n_removed.alias("_n_removed"))


def report(deduped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return deduped.select(
        F.col(id_col).alias("doc_id"),
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_removed").alias("n_removed"),
        F.sha2(F.col(text_col).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, CASE WHEN text IS NULL THEN NULL ELSE string_split(text, chr(10)) END AS lines FROM documents
), w AS (
  SELECT doc_id, p AS pos, lines[p + 1] || chr(10) || lines[p + 2] || chr(10) || lines[p + 3] AS win
  FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS p FROM l WHERE len(lines) >= 3)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM w
), c AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1
), g AS (
  SELECT doc_id, list(pos) AS covered FROM c GROUP BY doc_id
)
SELECT l.doc_id,
       coalesce(len(l.lines), 0)::BIGINT AS n_lines,
       coalesce(len(g.covered), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN g.covered IS NULL THEN l.text
              ELSE array_to_string(list_filter(list_transform(range(0, len(l.lines)), lambda i: CASE WHEN list_contains(g.covered, i) THEN NULL ELSE l.lines[i + 1] END), lambda x: x IS NOT NULL), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
