"""Queries of the operators for training data, by module, and SQL for those whose result SQL can express."""

from __future__ import annotations

import importlib

#: query -> module of this package that has the function of that name.
MODULES = {
    "op1_substring_dedup": "substring_dedup",
    "op2_quality_classifier": "quality",
    "op3_benchmark_decontamination": "decontamination",
    "op4_sentencepiece": "piece_tokens",
    "op5_suffix_array_dedup": "suffix_dedup",
    "op6_sharding": "sharding",
    "op7_license_scans": "license_scan",
    "op8_ngram_jaccard_join": "ngram_join",
    "op9_media_ogg": "media_ogg",
    "op10_secret_scans": "secrets_scan",
}


def query(name: str):
    return getattr(importlib.import_module(f"weftline.llm.{MODULES[name]}"), name)


def oracles() -> dict[str, str]:
    return importlib.import_module("weftline.llm.sql").ORACLES
