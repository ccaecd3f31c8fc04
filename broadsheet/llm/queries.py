"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .sql import ORACLE


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents"), with_bytes=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify

    return identify(read_table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("items")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece import encode

    return encode(read_table(spark, sf_dir, "documents"), with_ids=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license import scan_licenses

    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_blocks", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"), F.round("gain", 6).alias("gain"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_mixture": op2_language_mixture,
    "op3_warc_index": op3_warc_index,
    "op4_pii": op4_pii,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_bag_minhash": op6_bag_minhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_license_scan": op9_license_scan,
    "op10_top_k": op10_top_k,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
