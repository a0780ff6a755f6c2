"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, importance, langid, media, merkle, mixing, ngram, pii, sharding, simhash, suffix_dedup, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_pii": pii.op2_pii,
        "op3_sharding": sharding.op3_sharding,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_token_wavelet": tokens.op5_token_wavelet,
        "op6_mixing": mixing.op6_mixing,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_media_copies": media.op8_media_copies,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_language_id": langid.op10_language_id,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_lm_scoring": ngram.op12_lm_scoring,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.OP6_SQL,
        "op11_importance_resampling": importance.OP11_SQL,
        "op12_lm_scoring": ngram.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
