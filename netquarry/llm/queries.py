"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: name: (module, name of its SQL or None)
_OPERATORS = {
    "op1_url_filters": ("url_filters", "OP1_SQL"),
    "op2_license_scans": ("licenses", None),
    "op3_toxicity": ("toxicity", None),
    "op4_lm_scoring": ("katz", None),
    "op5_benchmark_decontamination": ("decontamination", "OP5_SQL"),
    "op6_ngram_jaccard_join": ("jaccard_join", None),
    "op7_media_columns": ("media", None),
    "op8_sentencepiece": ("pieces", None),
    "op9_quality_classifier": ("quality", None),
    "op10_warc": ("warc", "OP10_SQL"),
    "op11_source_divergence": ("divergence", "OP11_SQL"),
    "op12_token_counts": ("token_counts", None),
    "op13_collocations": ("collocations", "OP13_SQL"),
}

QUERIES = {name: getattr(import_module(f".{module}", __package__), name) for name, (module, _) in _OPERATORS.items()}
ORACLES = {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in _OPERATORS.items() if sql}
