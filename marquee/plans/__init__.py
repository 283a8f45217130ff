"""Registered queries: each module pairs Spark jobs with their SQL twins."""

from importlib import import_module

MODULES = ["features", "profiles", "sources", "ranked", "texts", "evaluated", "conversed", "searched", "completed"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"marquee.plans.{name}")
