"""Queries and oracle SQL of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ["frequencies", "distinct", "heavy", "sampling", "splitting", "seen", "packing", "mixing", "spans"]


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"strandmill.llm.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
