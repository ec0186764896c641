"""Imports every query module, which fills the registry."""

from importlib import import_module

from undertow.plans.registry import ORACLES, QUERIES

MODULES = ["queries_prep", "queries_eval", "queries_vectors", "queries_manifold", "queries_io", "queries_streaming", "queries_sql"]

for _name in MODULES:
    import_module(f"undertow.plans.{_name}")

__all__ = ["QUERIES", "ORACLES"]
