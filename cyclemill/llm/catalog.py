"""The operators' queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from cyclemill.llm import backoff, conversation_repair, hard_negatives, language_id, media, mixing, near_dedup, packing, preferences, pu_quality, quality, stages, token_rollups, url_rules


def queries() -> dict[str, Callable]:
    return {
        "pipeline": stages.run,
        "op1_media_columns": media.op1_media_columns,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_preference_formatting": preferences.op3_preference_formatting,
        "op4_token_rollups": token_rollups.op4_token_rollups,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_entropy_mixing": mixing.op6_entropy_mixing,
        "op7_url_filters": url_rules.op7_url_filters,
        "op8_stupid_backoff": backoff.op8_stupid_backoff,
        "op9_language_id": language_id.op9_language_id,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_quality_classifier": pu_quality.op13_quality_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_preference_formatting": preferences.ORACLE,
        "op4_token_rollups": token_rollups.ORACLE,
        "op7_url_filters": url_rules.ORACLE,
        "op8_stupid_backoff": backoff.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
    }
