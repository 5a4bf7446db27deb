"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name: (module, name of its SQL or None)
_PLACES = {
    "op1_chat_formatting": ("chat", "OP1_SQL"),
    "op2_minhash_near_dedup": ("minhash", None),
    "op3_media_columns": ("media", None),
    "op4_substring_dedup": ("substrings", None),
    "op5_byte_level_bpe": ("bpe", None),
    "op6_best_fit_packing": ("packing", None),
    "op7_url_filters": ("url_filters", "OP7_SQL"),
    "op8_token_counts": ("token_counts", None),
    "op9_toxicity": ("toxicity", None),
    "op10_nearest_neighbours": ("ann", None),
    "op11_spelling_variants": ("variants", "OP11_SQL"),
    "op12_online_packing": ("online_packing", None),
    "op13_merkle_manifest": ("merkle", "OP13_SQL"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"lexcheck.llm.{module}"), name) for name, (module, _) in _PLACES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"lexcheck.llm.{module}"), sql) for name, (module, sql) in _PLACES.items() if sql}
