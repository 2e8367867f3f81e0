"""The queries of this subpackage, by name, and the SQL of those that have any."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_secrets": "secrets",
    "op3_toxicity": "toxicity",
    "op4_url_filter": "urlfilter",
    "op5_extract": "extract",
    "op6_language": "language",
    "op7_telephony": "telephony",
    "op8_substring_dedup": "substrings",
    "op9_bpe": "bpe",
    "op10_simhash": "simhash",
}


def _run(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: importlib.import_module(f"stratalog.llm.{module}").query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(module) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from stratalog.llm import sql

    return dict(sql.ORACLES)
