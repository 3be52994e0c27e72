"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from .common import table

#: name: (module, function, table, has SQL)
_QUERIES = {
    "op1_warc_fixity": ("warc", "op1", "pages", True),
    "op2_tree_neighbours": ("neighbours", "op2", "embeddings", False),
    "op3_mix_sources": ("mixing", "op3", "documents", True),
    "op4_near_dedup": ("neardup", "op4", "documents", True),
    "op5_license_scan": ("licenses", "op5", "documents", True),
    "op6_suffix_dedup": ("repeats", "op6", "documents", False),
    "op7_line_dedup": ("lines", "op7", "documents", True),
    "op8_token_planes": ("bitplane", "op8", "documents", False),
    "op9_pack_windows": ("packing", "op9", "documents", False),
    "op10_quality_rules": ("quality", "op10", "documents", True),
}


def _query(module: str, function: str, of: str):
    f = getattr(import_module(f"{__package__}.{module}"), function)
    return lambda spark, sf_dir: f(table(spark, sf_dir, of))


def queries() -> dict:
    return {name: _query(m, f, of) for name, (m, f, of, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"{__package__}.{m}").SQL for name, (m, _, _, sql) in _QUERIES.items() if sql}
