"""Queries over the project's tables; each module registers its own."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "texts", "motion", "statistics", "catalog", "batching", "files")


def load() -> None:
    """Register the queries of all modules."""
    for name in MODULES:
        import_module(f"stepforge.plans.{name}")
