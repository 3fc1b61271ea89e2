"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosspolytope, hilbert, langid, linededup, minhash, mixing, substring, urlfilter, vptree
from .common import owned, table

WORD_BPE = "word_bpe_49k.json"
SHARD_BY = ["source", "lang", "n_chars"]


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(minhash.near_duplicates(table(spark, sf_dir, "documents")))


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(linededup.dedup_lines(table(spark, sf_dir, "documents")))


def op3_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.search_table(table(spark, sf_dir, "embeddings"), every=50, k=5)


def vantage_point_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 at factor one, which skips nothing that counts; scores to nine digits."""
    found = vptree.search_table(table(spark, sf_dir, "embeddings"), every=50, k=5, factor=1.0)
    return found.withColumn("score", F.round("score", 9))


def op4_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix(table(spark, sf_dir, "documents"))[1])


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.report(hilbert.shard(table(spark, sf_dir, "documents"), SHARD_BY, shards=16))


def op6_url_character_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), urlfilter.RULES).drop("url")


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_de_bruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(substring.dedup(table(spark, sf_dir, "documents")))


Query = Callable[[SparkSession, str], DataFrame]


def _owned(name: str, query: Query) -> Query:
    """The query, with its result as a table and the tables of its steps deleted."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return owned(spark, name, lambda: query(spark, sf_dir))

    return run


QUERIES: dict[str, Query] = {
    "op1_minhash_odd_sketch": _owned("op1", op1_minhash_odd_sketch),
    "op2_line_windows": _owned("op2", op2_line_windows),
    "op3_vantage_point_trees": _owned("op3", op3_vantage_point_trees),
    "vantage_point_exact": _owned("op3", vantage_point_exact),
    "op4_low_discrepancy_mix": _owned("op4", op4_low_discrepancy_mix),
    "op5_hilbert_shards": _owned("op5", op5_hilbert_shards),
    "op6_url_character_models": _owned("op6", op6_url_character_models),
    # One narrow pass without steps.
    "op7_bpe_encode_decode": op7_bpe_encode_decode,
    "op8_cross_polytope": _owned("op8", op8_cross_polytope),
    "op9_ecoc_language_id": _owned("op9", op9_ecoc_language_id),
    "op10_de_bruijn_substrings": _owned("op10", op10_de_bruijn_substrings),
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_odd_sketch": minhash.ORACLE,
    "op2_line_windows": linededup.ORACLE,
    "vantage_point_exact": vptree.EXACT_ORACLE,
    "op4_low_discrepancy_mix": mixing.ORACLE,
    "op5_hilbert_shards": hilbert.oracle(SHARD_BY),
    "op8_cross_polytope": crosspolytope.ORACLE,
    "op10_de_bruijn_substrings": substring.ORACLE,
}
