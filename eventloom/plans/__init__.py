"""Registered queries, one module per area."""

from eventloom.plans.registry import QUERIES

MODULES = ["events", "series", "scalars", "relational", "statistics", "audits", "spatial", "graph", "controls", "tables", "modelling", "scans"]


def load() -> dict:
    from importlib import import_module

    for name in MODULES:
        import_module(f"eventloom.plans.{name}")
    return QUERIES
