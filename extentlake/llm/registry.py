"""Queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from . import chat_format, decontaminate, jaccard_join, language_id, packing, sharding, substring_dedup, topk, url_filters, warc

_MODULES = {
    "op1_sharding": sharding,
    "op2_chat_format": chat_format,
    "op3_language_id": language_id,
    "op4_exact_topk": topk,
    "op5_substring_dedup": substring_dedup,
    "op6_warc": warc,
    "op7_packing": packing,
    "op8_jaccard_join": jaccard_join,
    "op9_url_filters": url_filters,
    "op10_decontaminate": decontaminate,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLES = {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
