"""The queries of this subpackage for the entry module, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, ann_mih, bpe_words, decontam, html_templates, lang_id, license_scan, merkle, secret_scan, simhash, suffix_dedup, url_filter, window_dedup
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op1_query(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_mih.op2_query(table(spark, sf_dir, "embeddings"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_templates.op3_query(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.op4_query(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op5_query(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op6_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontam_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.proximity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7_query(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op8_query(table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op9_query(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.op10_query(spark, table(spark, sf_dir, "documents"))


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.op11_query(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op12_query(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.op13_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_nearest": op2_nearest,
    "op3_html_text": op3_html_text,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_decontamination": op6_decontamination,
    "decontam_proximity": decontam_proximity,
    "op7_simhash": op7_simhash,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
    "op11_window_dedup": op11_window_dedup,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op4_language_id": lang_id.ORACLE,
    "op6_decontamination": decontam.ORACLE,
    "op9_suffix_dedup": suffix_dedup.ORACLE,
    "op11_window_dedup": window_dedup.ORACLE,
    "op12_merkle": merkle.ORACLE,
}
