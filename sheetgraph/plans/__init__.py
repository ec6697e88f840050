"""Queries over the derived views, and the SQL that says the same."""

from importlib import import_module

from sheetgraph.plans.registry import ORACLES, QUERIES

MODULES = ("netlist", "checks", "layout", "census", "cleaning", "review", "geometry")
for _name in MODULES:
    import_module(f"sheetgraph.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
