"""Queries and oracle SQL of the core, by module."""

from __future__ import annotations

from importlib import import_module

MODULES = ["operators.parse_lines", "operators.kmers", "operators.readstats", "operators.graph", "operators.walks", "operators.align", "streaming.screen", "plans.roundtrips"]


def _gather(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"strandmill.{m}"), what)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")
