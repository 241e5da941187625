"""Registered queries: one per operator, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

AREAS = ("scoring", "evaluation", "profiling", "cleaning", "association", "splits", "lookups", "fitting", "explanation", "flows", "streams")


def _modules():
    return [import_module(f"registry.{area}") for area in AREAS]


def queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.REG.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.REG.oracles.items()}
