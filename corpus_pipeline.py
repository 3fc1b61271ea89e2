"""A training corpus from raw documents, in five stages.

Language ID drops documents whose language cannot be told; line dedup removes repeated three-line
passages, and documents that it has emptied go; near-dedup keeps one document of each group; mixing
repeats and cuts each source's documents to its target, in the order of its schedule; BPE encodes what is
left. Each stage works on all rows of the one before and returns the columns of `documents`, but for the
last, which returns the encodings' digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakv.llm import bpe, langid, linededup, minhash, mixing
from stratakv.llm.common import WORD_PATTERN, owned, table
from stratakv.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    deduped = linededup.dedup_lines(docs)
    emptied = (F.col("_n_removed") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    return deduped.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_decode(docs, tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("source_mix", mix_sources),
    ("bpe_encode", encode),
]

#: Classifiers, sketches and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Tables of a stage's steps go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = owned(spark, f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return docs
