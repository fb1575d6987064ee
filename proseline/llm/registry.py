"""The driver queries of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from proseline.llm import chat, decontamination, embeddings, packing, pii, quality, repeats, sharding, simhash, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
        "op2_best_fit_packing": packing.op2_best_fit_packing,
        "op3_sharding": sharding.op3_sharding,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_pii": pii.op6_pii,
        "op7_token_output": tokens.op7_token_output,
        "op8_simhash": simhash.op8_simhash,
        "op9_quality_classifier": quality.op9_quality_classifier,
        "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": repeats.ORACLE_OP1,
        "op3_sharding": sharding.ORACLE_OP3,
        "op4_chat_formatting": chat.ORACLE_OP4,
        "op5_decontamination": decontamination.ORACLE_OP5,
        "op10_embedding_near_dedup": embeddings.ORACLE_OP10,
    }
