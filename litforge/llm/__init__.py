"""Operators for preparing training text: sharding, deduplication, packing, filtering, archives."""

from __future__ import annotations

import importlib

#: Modules that register queries; each has QUERIES and ORACLE_SQL.
MODULES = ("ngram_join", "bpe", "sharding", "suffix_dedup", "ann", "packing", "toxicity", "quality", "html_extract", "warc")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{name}"), attribute)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE_SQL")
