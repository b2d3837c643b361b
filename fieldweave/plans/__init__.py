"""Registered queries, grouped by the kind of work they do."""

from importlib import import_module

GROUPS = ["tables", "aggregates", "ordering", "vectors", "geometry", "association", "models"]


def load_all() -> None:
    for name in GROUPS:
        import_module(f"{__name__}.{name}")
