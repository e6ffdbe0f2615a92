"""Queries opN_<name> and pipeline: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
import public_tokenizers
from faultline.llm import oracles
from faultline.llm.bpe import encode_decode
from faultline.llm.decontamination import leaks
from faultline.llm.lexical_search import ranked_search
from faultline.llm.licenses import license_scan
from faultline.llm.line_dedup import line_dedup
from faultline.llm.near_dedup import near_duplicates
from faultline.llm.pii import pii_digest
from faultline.llm.quality_model import quality_scores
from faultline.llm.quality_rules import quality_verdicts
from faultline.llm.sentencepieces import encode_decode as encode_decode_pieces
from faultline.llm.spelling import spelling_variants
from faultline.llm.token_counts import line_token_counts
from faultline.llm.toxicity import toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_token_counts(table(spark, sf_dir, "documents"), RANKS)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_pieces(table(spark, sf_dir, "documents"), PIECES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_license_scan": op2_license_scan,
        "op3_decontamination": op3_decontamination,
        "op4_toxicity": op4_toxicity,
        "op5_line_dedup": op5_line_dedup,
        "op6_quality_model": op6_quality_model,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_bpe": op10_bpe,
        "op11_ranked_search": op11_ranked_search,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_spelling": op13_spelling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": oracles.LICENSE_SCAN, "op8_quality_rules": oracles.QUALITY_RULES, "op9_near_duplicates": oracles.NEAR_DUPLICATES, "op11_ranked_search": oracles.RANKED_SEARCH, "op13_spelling": oracles.SPELLING_VARIANTS}
