"""Registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    bagminhash,
    bwt_dedup,
    decontaminate,
    html_mincut,
    langid,
    line_crf,
    merkle,
    mixing,
    pii,
    rlz_dedup,
    token_align,
    toxicity,
    urls,
)
from .common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_pages(table(spark, sf_dir, "pages"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "score", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_text()).drop("path")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("removed")


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_line_quality": op2_line_quality,
    "op3_personal_data": op3_personal_data,
    "op4_repeated_bytes": op4_repeated_bytes,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_decontaminate": op6_decontaminate,
    "op7_mix_sources": op7_mix_sources,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_repeated_passages": op13_repeated_passages,
}
