"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name: the module of this package that holds the function of that name.
WHERE = {
    "op1_packing": "packing",
    "op2_suffixes": "suffixes",
    "op3_simhash": "simhash",
    "op4_quality": "quality",
    "op5_media": "ogg",
    "op6_chat": "chat",
    "op7_language": "langid",
    "op8_licenses": "licenses",
    "op9_top_k": "vafile",
    "op10_byte_bpe": "byte_bpe",
    "op11_alignment": "align",
    "op12_divergence": "divergence",
    "op13_html": "wrappers",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"clusterlake.llm.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from clusterlake.llm import chat, divergence, vafile, wrappers

    return {"op6_chat": chat.SQL, "op9_top_k": vafile.SQL, "op12_divergence": divergence.SQL, "op13_html": wrappers.SQL}
