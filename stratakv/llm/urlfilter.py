"""URL filter: host and path rules, then a likelihood ratio of two character language models.

Rules: the longest rule whose host is the URL's host or a parent domain of it, and whose path starts
the URL's path, decides. Length counts host and path together; ties go to block. URLs meet rules by joins on
host suffix and path prefix, so a list of any length is a table, not an expression.

Other URLs go to the method. Two smoothed variable-order Markov models, one of rejected and one of
accepted URLs, give each byte a probability from the longest contexts that the model has counts for:
order by order, p = (n(context, byte) + s * p of the shorter context) / (n(context) + s), so a context
never seen leaves the shorter one's value. A URL's score is the difference of log-likelihoods,
rejected less accepted, divided by its length. It is blocked if the score is above a threshold,
which is calibrated on accepted URLs kept out of the counts: at most `LOSS` of them lie above it.

In the query, URLs under a block rule are the rejected ones, and all others (allowed or unknown) the
accepted ones: what looks far more like blocked URLs than like the rest is blocked. Counts cover all
URLs but the calibration fold (CRC-32 of the URL modulo 5 is 0). They are exact: an n-gram is its own
key (five symbols of nine bits), in a table that grows with the distinct n-grams of the input.

Defined results: null URLs, and URLs without `://`, have empty host and path, match no rule and are
allowed; an empty class (no rejected or no accepted URL) allows all URLs without a rule; repeated
rows are judged alike; an empty table gives an empty result. Other columns are not read.

Plan: what a byte adds to the score depends on the ORDER bytes that end there alone. One narrow pass
counts these n-grams by class, and a shuffle sums them; shorter ones are sums of longer ones, and the
probabilities are built from short to long by joins on the context and on the shorter n-gram, which at
most 257 rows share. The n-grams with the most occurrences, `HOT` at most, are broadcast and added up
where the URLs are; occurrences of all others are joined with the table and summed by row. Whatever is
broadcast, scores are the same: they are added as whole numbers. Nothing is keyed by host, so a host
with a third of all URLs changes nothing; no n-gram left to the join has more than 2 / `HOT` of all
occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_arrow, materialize, slices, text_bytes

#: (verdict, host, path)
Rule = tuple[str, str, str]
ORDER = 5
SMOOTH = 2.0
LOSS = 0.01
#: Most n-grams that are broadcast; the rest are joined.
HOT = 1 << 16
#: A symbol's bits in an n-gram's key, and the whole number that stands for 1 in a sum of log-ratios.
BITS, UNIT = 9, 2.0**30
#: Width of a bin of the scores' histogram, and its range either way.
BIN, RANGE = 0.002, 8.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"\A([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def match_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """urls: (at, host, path). (at, rule, said) of the URLs that a rule fits: the longest one's name and verdict.

    Joins on equality alone: a URL meets rules through each suffix of its host that begins at a label, as
    far as the longest rule's host, and each prefix of its path of a length that some rule has. Suffixes of
    a host are read from its end, so a long one costs no more than the longest rule's host does.
    """
    if not rules:
        return urls.select("at", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("said")).limit(0)
    spark = urls.sparkSession
    known = spark.createDataFrame([(v, h, p) for v, h, p in sorted(set(rules))], "said string, rule_host string, rule_path string")
    longest, lengths = max(len(h) for _, h, _ in rules), sorted({len(p) for _, _, p in rules})
    host, path = F.col("host"), F.col("path")
    # The host's end, and what stands before each of its dots.
    end = F.when(F.length(host) > longest, F.expr(f"right(host, {longest + 1})")).otherwise(F.concat(F.lit("."), host))
    labels = F.split(end, r"\.")
    suffix = F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefix = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    some = urls.where((host != "") & (F.size(labels) > 1)).select("at", F.explode(suffix).alias("rule_host"), prefix.alias("prefixes"))
    met = some.select("at", "rule_host", F.explode("prefixes").alias("rule_path")).join(known, ["rule_host", "rule_path"])
    # Longest first; block before allow; then by name.
    order = F.struct(-(F.length("rule_host") + F.length("rule_path")), (F.col("said") != "block"), F.col("rule_host"), F.col("rule_path"), F.col("said"))
    best = met.groupBy("at").agg(F.min(order).alias("r"))
    return best.select("at", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.said").alias("said"))


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Key of the ORDER bytes that end at each byte, the last one lowest; and row offsets.

    Each row is read after ORDER - 1 marks, so its first bytes have contexts too.
    """
    raw, offsets = text_bytes(texts)
    pad = ORDER - 1
    rows = len(offsets) - 1
    data = np.full(len(raw) + pad * rows, 1, dtype=np.int64)
    at = np.arange(len(raw)) + np.repeat((np.arange(rows) + 1) * pad, np.diff(offsets))
    data[at] = raw.astype(np.int64) + 2
    key = np.zeros(len(at), dtype=np.int64)
    for n in range(ORDER):
        key |= data[at - n] << (BITS * n)
    return key, offsets


def count(labelled: DataFrame) -> DataFrame:
    """labelled: (url, cls); cls 1: rejected, 0: accepted, null: not learned from.

    (g, n, n0, n1): each n-gram of the URLs, its occurrences, and those in either class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", 1 << 20):
                key, offsets = grams(part.column(0))
                cls = np.repeat(part.column(1).fill_null(2).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
                g, at = np.unique(key, return_inverse=True)
                n = np.bincount(at * 3 + cls, minlength=3 * len(g)).reshape(-1, 3)
                for i in range(0, len(g), 65536):
                    s = slice(i, i + 65536)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[s], n[s].sum(axis=1), n[s, 0], n[s, 1])], names=["g", "n", "n0", "n1"])

    found = labelled.select("url", F.col("cls").cast("int").alias("cls")).transform(map_arrow, run, "g long, n long, n0 long, n1 long")
    return found.groupBy("g").agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))


def log_ratios(counts: DataFrame) -> DataFrame | None:
    """counts: (g, n, n0, n1). (g, n, r): log of g's last byte's probability, rejected less accepted, in UNITs.

    None if a class is empty.
    """
    levels = [counts]
    for n in range(ORDER - 2, -1, -1):
        shorter = levels[0].groupBy(_last(n + 1).alias("g")).agg(*(F.sum(c).alias(c) for c in ("n", "n0", "n1")))
        levels.insert(0, materialize(shorter, f"url-grams-{n + 1}"))
    total = levels[0].agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    if not total["n0"] or not total["n1"]:
        return None
    p = levels[0].select("g", "n", *((F.col(f"n{c}") + SMOOTH / 256) / (total[f"n{c}"] + SMOOTH) for c in (0, 1))).toDF("g", "n", "p0", "p1")
    for n in range(1, ORDER):
        rows = levels[n].select("g", "n", "n0", "n1", F.shiftright("g", BITS).alias("context"), _last(n).alias("shorter"))
        context = rows.groupBy("context").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
        both = rows.join(context, "context").join(p.select(F.col("g").alias("shorter"), "p0", "p1"), "shorter")
        p = both.select("g", "n", *((F.col(f"n{c}") + SMOOTH * F.col(f"p{c}")) / (F.col(f"all{c}") + SMOOTH) for c in (0, 1))).toDF("g", "n", "p0", "p1")
    return p.select("g", "n", F.round((F.log("p1") - F.log("p0")) * UNIT).cast("long").alias("r"))


def _last(n: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def _hot(ratios: DataFrame, hot: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Keys and log-ratios of the n-grams with at least `least` occurrences, hot of them at most."""
    by_size = {r["size"]: r["count"] for r in ratios.groupBy(F.length(F.bin("n")).alias("size")).count().collect()}
    size, held = max(by_size, default=0) + 1, 0
    while size > 1 and held + by_size.get(size - 1, 0) <= hot:
        size -= 1
        held += by_size.get(size, 0)
    least = 1 << (size - 1)
    found = ratios.where(F.col("n") >= least).select("g", "r").toArrow()  # hot rows at most
    key, r = found.column("g").to_numpy(), found.column("r").to_numpy()
    order = np.argsort(key)
    return least, key[order], r[order]


def score(rows: DataFrame, ratios: DataFrame, hot: int = HOT) -> DataFrame:
    """rows: (at, url, ...), at unique. With score: rejected less accepted log-likelihood, by length."""
    least, keys, values = _hot(ratios, hot)
    shared = rows.sparkSession.sparkContext.broadcast((keys, values))

    def find(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, offsets = grams(texts)
        keys, values = shared.value
        at = np.searchsorted(keys, key)
        known = at < len(keys)
        known[known] = keys[at[known]] == key[known]
        out = np.zeros(len(key), dtype=np.int64)
        out[known] = values[at[known]]
        return key, offsets, known, out

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", 1 << 20):
                _, offsets, _, out = find(part.column(1))
                sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(out)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sums[offsets[1:]] - sums[offsets[:-1]])], names=[*part.schema.names, "near"])

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "url", 1 << 20):
                key, offsets, known, _ = find(part.column(1))
                owner = np.repeat(part.column(0).to_numpy(), np.diff(offsets))[~known]
                key = key[~known]
                for i in range(0, len(key), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array(owner[i : i + 65536]), pa.array(key[i : i + 65536])], names=["at", "g"])

    rest = rows.select("at", "url").transform(map_arrow, far, "at long, g long").join(ratios.where(F.col("n") < least).select("g", "r"), "g")
    sums = rest.groupBy("at").agg(F.sum("r").alias("far"))
    first = rows.select("at", "url", *(c for c in rows.columns if c not in ("at", "url")))
    near_rows = first.transform(map_arrow, near, StructType([*first.schema.fields, StructField("near", LongType())]))
    total = (F.col("near") + F.coalesce("far", F.lit(0))) / UNIT
    length = F.greatest(F.coalesce(F.octet_length("url"), F.lit(0)), F.lit(1))
    return near_rows.join(sums, "at", "left").withColumn("score", total / length).drop("near", "far")


def calibrate(scored: DataFrame, loss: float = LOSS) -> int:
    """scored: accepted URLs. The least bin with at most a share loss of the scores in it or above it."""
    n_bins = int(2 * RANGE / BIN) + 1
    n = np.zeros(n_bins, dtype=np.int64)
    for r in scored.groupBy(_bin(F.col("score")).alias("bin")).count().collect():  # n_bins rows at most
        n[r["bin"]] = r["count"]
    above = n[::-1].cumsum()[::-1]
    fits = np.flatnonzero(above <= loss * n.sum())
    return int(fits[0]) if n.sum() and len(fits) else n_bins


def _bin(score: Column) -> Column:
    return F.least(F.greatest(F.floor((score + RANGE) / BIN), F.lit(0)), F.lit(int(2 * RANGE / BIN))).cast("int")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", loss: float = LOSS, hot: int = HOT) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score, by) for each row; by: what decided, rule, model or none (no URL)."""
    url = F.col("url")
    host, path = split_url(url)
    # Kept: at is another number in each run of a plan.
    rows = pages.select(F.monotonically_increasing_id().alias("at"), F.col(url_col).alias("url"), F.col(id_col).alias("id"))
    rows = materialize(rows.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit(""))), "urls")
    found = materialize(match_rules(rows.select("at", "host", "path"), rules), "url-rules")
    ruled = materialize(rows.join(found, "at", "left"), "url-ruled")
    seed = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    fold = F.crc32(url.cast("binary")) % 5 == 0
    blocked = F.coalesce(F.col("said") == "block", F.lit(False))
    learned = ruled.select("url", F.when(seed & ~fold, blocked.cast("int")).alias("cls"))
    ratios = log_ratios(materialize(count(learned), f"url-grams-{ORDER}"))
    if ratios is None:
        judged = ruled.withColumn("score", F.lit(0.0)).withColumn("method", F.lit("allow"))
    else:
        scored = materialize(score(ruled, materialize(ratios, "url-ratios"), hot), "url-scores")
        first = calibrate(scored.where(seed & fold & ~blocked), loss)
        judged = scored.withColumn("method", F.when(seed & (_bin(F.col("score")) >= first), "block").otherwise("allow"))
    by = F.when(F.col("said").isNotNull(), "rule").when(seed, "model").otherwise("none")
    return judged.select(F.col("id").alias("page_id"), "url", "host", "path", "rule", F.coalesce("said", "method").alias("verdict"), "score", by.alias("by"))


#: The rules of the registered query.
RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
