"""Queries of the training-data operators and their SQL, for the entry module at the repository's top."""

from __future__ import annotations

from importlib import import_module

#: Query -> (module of this subpackage, attribute with its DuckDB SQL or None where SQL can't express it).
REGISTRY = {
    "op1_html_extraction": ("html_extraction", None),
    "op10_katz": ("katz", None),
    "op2_language_id": ("language_id", None),
    "op3_token_counts": ("token_counts", None),
    "op4_embedding_dedup": ("embedding_dedup", "OP4_SQL"),
    "op5_quality": ("quality", None),
    "op6_decontamination": ("decontamination", "OP6_SQL"),
    "op7_sentencepiece": ("sentencepiece_fst", None),
    "op8_near_dedup": ("near_dedup", "OP8_SQL"),
    "op9_toxicity": ("toxicity", None),
}


def load() -> None:
    """Import every operator; raises ImportError if one lacks something that it needs."""
    for module, _ in REGISTRY.values():
        import_module(f"{__package__}.{module}")


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, (module, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in REGISTRY.items() if sql}
