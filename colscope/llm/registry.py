"""The queries of this package and, where SQL can express them, DuckDB SQL for their rows."""

from __future__ import annotations

import importlib

#: Query name -> module.
MODULES = {
    "op1_near_dedup": "near_dedup",
    "op2_sentencepiece": "sentencepiece_codec",
    "op3_mixing": "mixing",
    "op4_exact_dedup": "exact_dedup",
    "op5_toxicity": "toxicity",
    "op6_line_dedup": "line_dedup",
    "op7_warc": "warc",
    "op8_nearest": "vp_search",
    "op9_token_files": "token_files",
    "op10_url_filters": "url_filter",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}
    return found | {"pipeline": pipeline()}


def pipeline():
    import corpus_pipeline

    return corpus_pipeline.run


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
