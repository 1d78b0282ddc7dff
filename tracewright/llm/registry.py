"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import alignment, bpe, chat, codes, contamination, ivfpq, licenses, lines, mixing, planes, simhash, telephony, toxicity
from tracewright.llm.scratch import table


def tokenizer(name: str) -> str:
    """Place of a vocabulary file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op5_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op6_fuzzy_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op7_reply_tree_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op9_ivf_pq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.report(table(spark, sf_dir, "embeddings"))


def op10_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.text_features(table(spark, sf_dir, "documents"))


def op11_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_partial_distance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.report(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bitplane_ids": op1_bitplane_ids,
    "op2_ftrl_toxicity": op2_ftrl_toxicity,
    "op3_site_spread_lines": op3_site_spread_lines,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_water_filling_mix": op5_water_filling_mix,
    "op6_fuzzy_licenses": op6_fuzzy_licenses,
    "op7_reply_tree_chat": op7_reply_tree_chat,
    "op8_rank_array_bpe": op8_rank_array_bpe,
    "op9_ivf_pq_search": op9_ivf_pq_search,
    "op10_telephony_audio": op10_telephony_audio,
    "op11_prefix_set_join": op11_prefix_set_join,
    "op12_token_alignment": op12_token_alignment,
    "op13_partial_distance_codes": op13_partial_distance_codes,
}

ORACLE_SQL: dict[str, str] = {
    "op3_site_spread_lines": lines.ORACLE,
    "op5_water_filling_mix": mixing.ORACLE,
    "op7_reply_tree_chat": chat.ORACLE,
    "op11_prefix_set_join": contamination.ORACLE,
    "op13_partial_distance_codes": codes.ORACLE,
}
