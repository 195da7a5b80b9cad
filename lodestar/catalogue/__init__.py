"""Registered queries by area, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

AREAS = ("filters", "retrieval", "texts", "knowledge", "operations", "plans", "planning", "curation", "registers", "composites")


def queries() -> dict[str, Callable]:
    return {k: f for area in AREAS for k, f in import_module(f"lodestar.catalogue.{area}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for area in AREAS for k, s in import_module(f"lodestar.catalogue.{area}").ORACLE.items()}
