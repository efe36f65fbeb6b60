"""Queries of the ten operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: query name: (module, function with (spark, sf_dir), function with the SQL or None).
NAMES = {
    "op1_html": ("html", "op1_html", None),
    "op2_embeddings": ("embeddings", "op2_embeddings", "op2_sql"),
    "op3_mixing": ("mixing", "op3_mixing", None),
    "op4_minhash": ("minhash", "op4_minhash", "op4_sql"),
    "op5_quality": ("quality", "op5_quality", "op5_sql"),
    "op6_classlm": ("classlm", "op6_classlm", None),
    "op7_token_counts": ("token_counts", "op7_token_counts", None),
    "op8_toxicity": ("toxicity", "op8_toxicity", None),
    "op9_packing": ("packing", "op9_packing", None),
    "op10_licenses": ("licenses", "op10_licenses", None),
}


def queries() -> dict:
    at = lambda module, name: getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return {q: at(module, name) for q, (module, name, _) in NAMES.items()}


def oracle_sql() -> dict[str, str]:
    at = lambda module, name: getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return {q: at(module, sql)() for q, (module, _, sql) in NAMES.items() if sql}
