"""All queries of the engine, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("queries_checks", "queries_spans", "queries_stages", "queries_reports", "queries_tools", "queries_recognizers")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), attribute)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
