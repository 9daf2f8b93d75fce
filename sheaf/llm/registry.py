"""Queries of the training-data operators and, where SQL can express them, the SQL to check them."""

from __future__ import annotations

from . import bpe, chat, ctw, exact_dedup, langid, licenses, manifest, neighbours, packing, partenum, retention, simhash, substring

MODULES = (substring, langid, bpe, packing, ctw, licenses, exact_dedup, neighbours, chat, simhash, partenum, manifest, retention)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
