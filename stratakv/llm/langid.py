"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword of bits; a linear classifier on hashed byte n-gram frequencies
predicts each bit; loss-weighted decoding adds up, for each language, the logistic losses of the
bits' margins against its codeword, and the smallest sum wins. The score is the softmax share of the
winner. A document is ambiguous if the runner-up's loss is within `AMBIGUOUS` of the winner's, that
is, if the codewords do not tell the two apart.

All languages of the labelled rows are learned. Fitting uses a bounded sample of these rows: at most
`SAMPLE_PER_LANG` documents of each language, and `SAMPLE_ROWS` in all but never less than one of each,
chosen by hashes of id and text, so reruns agree. Repeated rows count once; null and repeated ids are fine.
Prediction reads whole texts and nothing but text.

Defined results: null text, and text without a letter, is `und` with score 0; with no labelled rows
every row is `und`; with one language all texts with letters get it, with score 1. Rows repeat as
they come; an empty table gives an empty result; other columns are not read.

Plan: the sample is an aggregate, a row for each slot of a language, combined before the shuffle; its
features are made on the executors, so the driver holds SAMPLE_ROWS vectors, or one a language where there
are more languages, however long the texts; the model is (bits x BUCKETS) numbers, bits growing with the logarithm of the number of
languages. Prediction is one narrow pass in Arrow batches, vectorised over all bytes of a slice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, mix64, randoms, slices, text_bytes

SAMPLE_PER_LANG = 400
#: Slots for each row of a language's sample.
SPREAD = 4
#: Most rows of all languages together, unless there are more languages; each is one vector of BUCKETS
#: numbers on the driver.
SAMPLE_ROWS = 8192
#: Beyond this many languages the first random words that are far apart do.
FEW_LANGS = 256
BUCKETS = 4096
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.05
EPOCHS = 200
RATE = 0.5
L2 = 1e-4

_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text))


def features(texts: pa.Array) -> np.ndarray:
    """Rows x BUCKETS: square roots of relative frequencies of byte n-grams, ASCII letters lower-cased.

    Bytes that are neither letters nor beyond ASCII count as a blank, runs of them as one.
    """
    raw, offsets = text_bytes(texts)
    fold = np.full(256, 32, dtype=np.uint8)
    fold[97:123], fold[128:] = np.arange(97, 123), np.arange(128, 256)
    fold[65:91] = fold[97:123]
    data = fold[raw]
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1])
    data, owner = data[keep].astype(np.uint64), owner[keep]
    out = np.zeros(rows * BUCKETS, dtype=np.float64)
    multipliers = randoms(77, max(ORDERS))
    for k in ORDERS:
        n = len(data) - k + 1
        if n <= 0:
            continue
        with np.errstate(over="ignore"):
            h = np.full(n, np.uint64(k), dtype=np.uint64)
            for i in range(k):
                h += (data[i : i + n] + np.uint64(1)) * multipliers[i]
            slot = (mix64(h) >> np.uint64(52)).astype(np.int64)
        same = owner[:n] == owner[k - 1 :]
        out += np.bincount((owner[:n] * BUCKETS + slot)[same], minlength=len(out))
    out = out.reshape(rows, BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n x bits of +1 and -1. For few languages all splits in two; else random words far apart."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.int8)
    if n <= 5:
        bits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, 1 << n, 2) if m != (1 << n) - 1]
        return np.array(bits, dtype=np.int8).T.reshape(n, -1)
    length = max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for trial in range(64):
        words = np.where(randoms(500 + trial, n * length).reshape(n, length) >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.int8)
        distance = _least_distance(words)
        if distance > apart and (np.abs(words.sum(axis=0, dtype=np.int64)) < n).all():
            best, apart = words, distance
        if n > FEW_LANGS and apart >= length // 8:
            break
    return best


def _least_distance(words: np.ndarray) -> int:
    """Least number of bits in which two rows of +1 and -1 differ; a block of products at a time."""
    n, length = words.shape
    signs = words.astype(np.float32)
    step = max(1, (1 << 22) // n)
    nearest = -length
    for at in range(0, n, step):
        gram = signs[at : at + step] @ signs.T
        gram[np.arange(len(gram)), np.arange(at, at + len(gram))] = -length
        nearest = max(nearest, int(gram.max()))
    return (length - nearest) // 2


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Rows x languages: summed logistic losses of the bits' margins against each codeword."""
        margin = x @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -margin), np.logaddexp(0, margin)
        return plus @ (self.codes > 0).T.astype(np.float64) + minus @ (self.codes < 0).T.astype(np.float64)


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """x: the rows' features."""
    names = sorted(set(langs))
    codes = codewords(len(names))
    if len(names) < 2:
        return Model(names, codes, np.zeros((BUCKETS, 0)), np.zeros(0))
    number = {name: i for i, name in enumerate(names)}
    y = np.array([number[v] for v in langs])
    share = 1.0 / (np.bincount(y)[y] * len(names))  # each language weighs the same
    target = codes[y].astype(np.float32)
    w, b = np.zeros((BUCKETS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    seen_w, seen_b = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(EPOCHS):
        margin = x @ w + b
        pull = -target / (1 + np.exp(np.clip(target * margin, -30, 30))) * share[:, None].astype(np.float32)
        gw, gb = x.T @ pull + L2 * w, pull.sum(axis=0)
        seen_w += gw * gw
        seen_b += gb * gb
        w -= RATE * gw / np.sqrt(seen_w)
        b -= RATE * gb / np.sqrt(seen_b)
    return Model(names, codes, w.astype(np.float64), b.astype(np.float64))


def held_out(id_col: Column) -> Column:
    """True where the CRC-32 of the id as text leaves remainder 0 modulo 5; null counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(labelled: DataFrame, per_lang: int) -> DataFrame:
    """(lang, h, t): hashes of at most per_lang distinct rows of each language, and of one at least.

    Rows fall into `SPREAD` * per_lang slots of their language by a hash of id and text; of a slot the row
    with the least hash stays, and of a language the per_lang least of these. Copies of a row share a slot
    and a hash, so however many there are they count once, and no row is left out for its id.
    """
    h, t = F.xxhash64("id", "text", F.lit(3)), F.xxhash64("text")
    named = labelled.select("lang", h.alias("h"), t.alias("t"))
    slot = F.pmod(F.xxhash64("h", "t", F.lit(4)), F.lit(SPREAD * per_lang)).cast("int")
    least = named.groupBy("lang", slot.alias("slot")).agg(F.min("h").alias("h"), F.min_by("t", "h").alias("t"))
    # At most SPREAD * per_lang rows a language, whatever the language holds.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    return least.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "h", "t")


def train(labelled: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model:
    """labelled: (id, text, lang). Fits on at most per_lang rows of each language, and on one at least."""
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    n_langs = rows.agg(F.count_distinct("lang")).first()[0]
    per_lang = max(1, min(per_lang, SAMPLE_ROWS // max(1, n_langs)))
    chosen = materialize(sample(rows, per_lang), "lang-sample")
    # The sample is bounded: SAMPLE_ROWS rows of three columns, or one a language.
    texts = rows.withColumn("h", F.xxhash64("id", "text", F.lit(3))).join(F.broadcast(chosen), ["lang", "h"]).where(F.xxhash64("text") == F.col("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    x = [row.tobytes() for row in features(some.column(3))]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(x, pa.binary())], names=["lang", "h", "t", "x"])

    # Copies of a chosen row are one again before their vectors are made.
    one = texts.groupBy("lang", "h", "t").agg(F.first("text").alias("text"))
    made = materialize(one.transform(map_arrow, run, "lang string, h long, t long, x binary"), "lang-vectors")
    # Row by row into one array: at most SAMPLE_ROWS vectors, or one a language.
    x, langs = np.empty((made.count(), BUCKETS), dtype=np.float32), []
    for row in made.orderBy("lang", "h", "t").toLocalIterator():
        x[len(langs)] = np.frombuffer(row["x"], dtype=np.float32)
        langs.append(row["lang"])
    return fit(x, langs)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) for each row of docs."""
    out = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, "text", 1 << 20):
                for at in range(0, block.num_rows, 256):
                    part = block.slice(at, 256)
                    yield _judge(part, model)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).transform(map_arrow, run, out)


def judge(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    n = len(texts)
    letters = np.fromiter((has_letter(t) for t in texts.to_pylist()), dtype=bool, count=n)
    if not model.langs or not n:
        return ["und"] * n, np.zeros(n), np.ones(n, bool)
    if len(model.langs) == 1:
        best, score, close = np.zeros(n, int), np.ones(n), np.zeros(n, bool)
    else:
        loss = model.losses(features(texts))
        ranked = np.argsort(loss, axis=1, kind="stable")
        best = ranked[:, 0]
        first, second = (np.take_along_axis(loss, ranked[:, i : i + 1], 1)[:, 0] for i in (0, 1))
        score = 1 / np.exp(first[:, None] - loss).sum(axis=1)
        close = second - first < AMBIGUOUS
    return [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, score, 0.0), close | ~letters


def _judge(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    names, score, close = judge(part.column(1), model)
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["id", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: (doc_id, held_out, lang_pred, score, ambiguous)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out(F.col("id"))))
    judged = predict(rows, model, "id", "text")
    return judged.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows whose language cannot be told: no letters, or codewords that tie."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(rows.where(~held_out(F.col("id"))))
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in slices(batch, schema[at].name, 1 << 20):
                for i in range(0, block.num_rows, 256):
                    part = block.slice(i, 256)
                    _, _, close = judge(part.column(at), model)
                    yield part.filter(pa.array(~close))

    return docs.transform(map_arrow, run, schema)
