"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Sizes are words. Sources in code-point order, null last, weigh 1, 2, 3 and so on over again, and
share the sum of all sizes; a target stops at `most` times its source's size and the excess goes to
the others by weight until none is above.

The schedule. Slot i has the point i * golden ratio modulo one, in whole numbers of 2 ** -48, and goes to
the source in whose part of the unit interval the point falls. A part is as wide as the source's share
of all slots, and a source's share is its target in blocks. The schedule has exactly as many slots as all
sources need together; what a source gets is what the points say.

What slots take. A source's documents are shuffled by a hash of their id, end to end, and cut into blocks
of equally many words (the last may be shorter): `block` words, fewer where the target would hold less
than `LEAST_SLOTS` of them. The source's slot of rank r takes block r modulo the number of blocks. So a
block is taken in the pass r / blocks, and slots beyond the `most`-th pass take nothing.

How near. N points of this sequence hit any part at most `bound(N)` = 3 + 3.53 ln N times more or less
than its share of N (the proven bound on its discrepancy; two or three times, as measured), so a source's
taken words miss its target by this many blocks at most: about one per cent where it has LEAST_SLOTS.
mix() counts the slots of every source and raises if one misses its need by more.

Defined results: null and blank texts have size 0, fill no block and are taken 0 words; null
doc_id is shuffled as the empty string; rows with the same doc_id are told apart by size and text
checksum, and equal rows are interchangeable; an empty table gives an empty result.

Plan: no window runs over a whole source. Documents fall into hash cells inside their source, so
many that a cell holds about `CELL_ROWS` rows; slots fall into chunks of fixed length; sums over cells and
chunks are taken on three levels (prefix.py). Blocks meet slots by (source, block).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize
from .prefix import sums_before

#: Points are whole numbers below 2 ** POINT_BITS; the step is the golden ratio in these, made odd.
POINT_BITS = 48
GOLDEN = (0x9E3779B97F4A7C15 >> 16) | 1
BLOCK_WORDS = 2048
LEAST_SLOTS = 4096
CELL_ROWS = 1024
CHUNK_SLOTS = 4096


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def bound(n: int) -> float:
    """Most by which n points hit a part more or less often than its share of n."""
    return 3 + 3.53 * math.log(max(n, 2))


def point(slot: Column, step: int = GOLDEN) -> Column:
    """slot * step modulo 2 ** POINT_BITS, for slots below 2 ** 45, with no product beyond 63 bits."""
    mask = (1 << POINT_BITS) - 1
    total = F.lit(0).cast("long")
    for piece in range(3):
        digits = F.shiftright(slot, 15 * piece).bitwiseAND(F.lit(0x7FFF).cast("long"))
        total = total + (digits * F.lit((step << (15 * piece)) & mask).cast("long")).bitwiseAND(F.lit(mask))
    return total.bitwiseAND(F.lit(mask))


def source_targets(sizes: DataFrame, block: int = BLOCK_WORDS, most: int = 3, least_slots: int = LEAST_SLOTS) -> DataFrame:
    """(source, sno, n_rows, source_size, weight, target, block, n_blocks, need, n_slots, low, high), one row a source.

    sno numbers the sources; low and high bound its part, in points. The running sums go over one row per
    source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = per.withColumn("sno", F.row_number().over(by_name)).withColumn("weight", ((F.col("sno") - 1) % 3 + 1).cast("long"))
    w = w.withColumn("total", F.sum("source_size").over(every)).withColumn("cap", F.col("source_size") * most)
    # Sources fill up in order of cap / weight. One is full if a level of the rest above it covers the cap.
    by_level = every.orderBy(F.col("cap").cast("double") / F.col("weight"), "sno")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # In doubles: at 100 TB the products do not fit in 64 bits.
    w = w.withColumn("full", (F.col("total") - F.col("capped_before")).cast("double") * F.col("weight") >= F.col("cap").cast("double") * F.col("weight_left"))
    w = w.withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)).withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every))
    w = w.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest").cast("double") / F.col("open_weight")))
    w = w.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / least_slots))).cast("long"))
    w = w.withColumn("n_blocks", F.expr("(source_size + block - 1) div block"))
    need = F.floor(F.col("target") * F.col("n_blocks") / F.col("source_size") + 0.5)
    w = w.withColumn("need", F.when(F.col("source_size") == 0, 0).otherwise(need).cast("long"))
    run = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = w.withColumn("n_slots", F.sum("need").over(every)).withColumn("upto", F.sum("need").over(run))
    edge = lambda c: F.expr(f"CASE WHEN need > 0 THEN (cast({c} AS decimal(20,0)) * {1 << POINT_BITS}L) div n_slots END")
    return w.select("source", "sno", "n_rows", "source_size", "weight", "target", "block", "n_blocks", "need", "n_slots", edge("(upto - need)").alias("low"), edge("upto").alias("high"))


def schedule(targets: DataFrame) -> DataFrame:
    """(sno, slot, rank, pass_no, block_no): the source of every slot, its rank there, and the block."""
    spark = targets.sparkSession
    head = targets.agg(F.max("n_slots").alias("n"), F.count("*").alias("sources")).first()
    # Parts and points meet in bins, several of them for each source.
    bits = min(30, max(10, (4 * head["sources"]).bit_length()))
    shift = POINT_BITS - bits
    slots = spark.range(head["n"] or 0).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    bins = F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))
    parts = targets.where("need > 0").select("sno", "n_blocks", "low", "high", F.explode(bins).alias("bin"))
    drawn = slots.withColumn("bin", F.shiftright("u", shift)).join(parts, "bin").where("u >= low AND u < high")
    drawn = materialize(drawn.select("sno", "n_blocks", "slot", F.floor(F.col("slot") / CHUNK_SLOTS).cast("long").alias("chunk")), "mix-drawn")
    chunks = drawn.groupBy("sno", "chunk").agg(F.count("*").alias("n"))
    _check(chunks, targets)
    starts = sums_before(chunks, ["sno"], "chunk", "n", "rank0").select("sno", "chunk", "rank0")
    nth = F.row_number().over(Window.partitionBy("sno", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("nth", nth).join(starts, ["sno", "chunk"]).withColumn("rank", F.col("rank0") + F.col("nth"))
    return ranked.select("sno", "slot", "rank", F.expr("rank div n_blocks").alias("pass_no"), F.expr("rank % n_blocks").alias("block_no"))


def _check(chunks: DataFrame, targets: DataFrame) -> None:
    """Raise if the slots of a source miss what it needs by more than the bound."""
    got = chunks.groupBy("sno").agg(F.sum("n").alias("got"))
    most = F.lit(3.0) + F.lit(3.53) * F.log(F.greatest(F.col("n_slots").cast("double"), F.lit(2.0)))
    off = targets.where("need > 0").join(got, "sno", "left").where(F.abs(F.coalesce("got", F.lit(0)) - F.col("need")) > most)
    if not off.isEmpty():
        raise ArithmeticError(f"the schedule misses a source's need: {off.select('sno', 'need', 'got').first()}")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, most: int = 3, least_slots: int = LEAST_SLOTS) -> tuple[DataFrame, DataFrame]:
    """The schedule and what it takes.

    Returns (slots, documents). slots: (source, sno, slot, rank, pass_no, block_no, words), one row a slot;
    words is what it takes. documents: (doc_id, size, text_crc, source, source_size, target, start, taken,
    first_slot, n_slots, copies): start is the document's first word in its source's shuffled stream, copies
    has the slot and the words of each time that it is taken.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        n_words(F.col(text_col)).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc"),
    )
    sized = materialize(sized.withColumn("shuffle", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    targets = materialize(source_targets(sized, block, most, least_slots), "mix-targets")

    # Each document's start in its source's stream: sums of cells first, then inside cells.
    s, t = sized.alias("s"), targets.select("source", "sno", "n_rows", "source_size", "target", "block").alias("t")
    known = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.*", "t.sno", "t.n_rows", "t.source_size", "t.target", "t.block")
    cells = F.expr(f"(n_rows + {CELL_ROWS - 1}) div {CELL_ROWS}")
    at = F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long").cast("double") / float(1 << 32)
    celled = known.withColumn("cell", F.floor(at * cells).cast("long"))
    sums = celled.groupBy("sno", "cell").agg(F.sum("size").alias("cell_size"))
    starts = sums_before(sums, ["sno"], "cell", "cell_size", "cell_start").drop("cell_size")
    inside = Window.partitionBy("sno", "cell").orderBy("shuffle", "size", "text_crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = celled.withColumn("in_cell", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["sno", "cell"])
    placed = placed.withColumn("start", F.col("cell_start") + F.col("in_cell"))
    placed = materialize(placed.select("sno", "doc_id", "size", "text_crc", "source", "source_size", "target", "block", "start"), "mix-places")

    length = F.least(F.col("block"), F.col("source_size") - F.col("block_no") * F.col("block"))
    slots = schedule(targets).join(targets.select("sno", "source", "source_size", "block"), "sno")
    slots = slots.withColumn("words", F.when(F.col("pass_no") < most, length).otherwise(0))
    slots = materialize(slots.select("source", "sno", "slot", "rank", "pass_no", "block_no", "words"), "mix-slots")

    # Blocks meet documents: in each pass a document is taken as far as its blocks are.
    per_pass = [F.min(F.when(F.col("pass_no") == p, F.col("slot"))).alias(f"s{p}") for p in range(most)]
    blocks = slots.where("words > 0").groupBy("sno", "block_no").agg(*per_pass)
    number = lambda word: F.expr(f"({word}) div block")
    spans = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(number("start"), number("start + size - 1"))))
    met = spans.join(blocks, ["sno", "block_no"])
    part = F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")) - F.greatest(F.col("start"), F.col("block_no") * F.col("block"))
    took = [F.sum(F.when(F.col(f"s{p}").isNotNull(), part).otherwise(0)).alias(f"w{p}") for p in range(most)]
    first = [F.min(f"s{p}").alias(f"s{p}") for p in range(most)]
    n = F.sum(sum((F.col(f"s{p}").isNotNull().cast("long") for p in range(most)), F.lit(0))).alias("n_slots")
    # (sno, start) names a document with words.
    got = met.groupBy("sno", "start").agg(*took, *first, n).alias("g")
    full = placed.alias("p").join(got, (F.col("p.sno") == F.col("g.sno")) & (F.col("p.start") == F.col("g.start")) & (F.col("p.size") > 0), "left")
    taken = sum((F.coalesce(f"w{p}", F.lit(0)) for p in range(most)), F.lit(0)).cast("long")
    copies = F.filter(F.array(*[F.struct(F.col(f"s{p}").alias("slot"), F.col(f"w{p}").cast("long").alias("words")) for p in range(most)]), lambda c: c["words"] > 0)
    out = full.select("p.doc_id", "p.size", "p.text_crc", "p.source", "p.source_size", "p.target", "p.start", taken.alias("taken"), F.least(*[F.col(f"g.s{p}") for p in range(most)]).alias("first_slot") if most > 1 else F.col("g.s0").alias("first_slot"), F.coalesce("g.n_slots", F.lit(0)).cast("long").alias("n_slots"), copies.alias("copies"))
    return slots, out


def report(documents: DataFrame) -> DataFrame:
    """first_slot: the first slot of the schedule that takes any of the document's words; n_slots: how many do."""
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """docs as the schedule takes them, in its order: a row for each time a document is taken, with all its
    words or, where its blocks run out, the first ones. Rows that the mix takes nothing of go."""
    _, got = mix(docs, id_col, text_col, source_col, **params)
    got = materialize(got.where("taken > 0"), "mix-taken")
    one = got.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc").alias("_crc"), F.col("source").alias("_source")).agg(F.sort_array(F.collect_list(F.struct("start", "copies"))).alias("_takes"))
    text = F.col(text_col)
    keyed = docs.withColumn("_n", n_words(text)).withColumn("_c", F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    # Equal rows are interchangeable: the nth of them is taken as the nth is.
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(id_col, "_n", "_c", source_col).orderBy(F.lit(0)))) if _repeats(got) else keyed.withColumn("_nth", F.lit(1))
    met = keyed.join(one, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & (F.col("_c") == F.col("_crc")) & F.col(source_col).eqNullSafe(F.col("_source")))
    each = met.withColumn("_copy", F.explode(F.get("_takes", F.col("_nth") - 1)["copies"]))
    first = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD_PATTERN})"), 1), F.lit(1), F.col("_copy")["words"].cast("int")), " ")
    cut = F.when(F.col("_copy")["words"] < F.col("_n"), first).otherwise(text)
    each = each.withColumn("_slot", F.col("_copy")["slot"]).select(*[cut.alias(c) if c == text_col else F.col(c) for c in docs.columns], "_slot")
    return each.orderBy("_slot", id_col).drop("_slot")


def _repeats(got: DataFrame) -> bool:
    same = got.groupBy("doc_id", "size", "text_crc", "source").count().where("count > 1")
    return not same.isEmpty()


ORACLE = f"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rn FROM s GROUP BY source
), w AS (
  SELECT *, (rn - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM p
), b AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped_before,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS weight_left FROM w
), f AS (
  SELECT *, (total - capped_before)::DOUBLE * weight >= cap::DOUBLE * weight_left AS is_full FROM b
), t AS (
  SELECT source, rn, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    weight * ((total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT)::DOUBLE / (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::BIGINT END AS target FROM f
), k AS (
  SELECT *, greatest(1, least({BLOCK_WORDS}, floor(target / {LEAST_SLOTS})))::BIGINT AS block FROM t
), q AS (
  SELECT *, (source_size + block - 1) // block AS n_blocks FROM k
), v AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target * n_blocks / source_size + 0.5) END::BIGINT AS need FROM q
), r AS (
  SELECT *, (sum(need) OVER ())::BIGINT AS n_slots, (sum(need) OVER (ORDER BY rn))::BIGINT AS upto FROM v
), e AS (
  SELECT *, (upto - need)::HUGEINT * {1 << POINT_BITS} // n_slots AS low, upto::HUGEINT * {1 << POINT_BITS} // n_slots AS high FROM r WHERE need > 0
), i AS (
  SELECT unnest(range(0, (SELECT max(n_slots) FROM e))) AS slot
), u AS (
  SELECT slot, slot::HUGEINT * {GOLDEN} % {1 << POINT_BITS} AS u FROM i
), z AS (
  SELECT e.rn, u.slot, e.n_blocks, row_number() OVER (PARTITION BY e.rn ORDER BY u.slot) - 1 AS rank FROM u JOIN e ON u.u >= e.low AND u.u < e.high
), y AS (
  SELECT rn, rank % n_blocks AS block_no, count(*) AS hits, min(slot) AS first_slot FROM z WHERE rank // n_blocks < 3 GROUP BY ALL
), d AS (
  SELECT s.doc_id, s.size, r.rn, r.source_size, r.target, r.block,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source
), o AS (
  SELECT doc_id, rn, block, start, start + size AS stop, unnest(range(start // block, (start + size - 1) // block + 1)) AS block_no FROM d WHERE size > 0
), g AS (
  SELECT o.doc_id, sum(y.hits * (least(o.stop, (o.block_no + 1) * o.block) - greatest(o.start, o.block_no * o.block))) AS taken, min(y.first_slot) AS first_slot, sum(y.hits) AS n_slots
  FROM o JOIN y ON o.rn = y.rn AND o.block_no = y.block_no GROUP BY o.doc_id
)
SELECT d.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
