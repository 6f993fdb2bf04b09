"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontam, exact_dedup, html_text, imatch, near_dedup, packing, prefix_trie, secrets, sharding, toxicity, url_lists, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1(_read(spark, sf_dir, "documents"))


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op2(_read(spark, sf_dir, "pages"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.op3(_read(spark, sf_dir, "documents"))


def op4_dated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.op4(_read(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op6(_read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op8(_read(spark, sf_dir, "documents"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op10(_read(spark, sf_dir, "pages"))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op11(_read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12(_read(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op13(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_interleave,
        op2_line_blocks,
        op3_circulant_minhash,
        op4_dated_lists,
        op5_secrets,
        op6_exact_dedup,
        op7_toxicity,
        op8_packing,
        op9_winnowing,
        op10_warc,
        op11_imatch,
        op12_prefix_trie,
        op13_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op3_circulant_minhash": near_dedup.SQL,
    "op4_dated_lists": url_lists.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op9_winnowing": decontam.SQL,
    "op10_warc": warc.SQL,
    "op11_imatch": imatch.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
}
