"""Runnable queries, grouped by theme; ``load_all`` fills the registry."""

from importlib import import_module

MODULES = ["geometry", "motion", "joins", "evaluation", "smoothing", "detection", "reports", "arcs", "tables", "live"]


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
