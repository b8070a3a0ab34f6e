"""Registered queries: an operator applied to the given tables, with its SQL oracle."""

from importlib import import_module

AREAS = ("scalars", "changelog", "storage", "corpus", "ledgers", "latency", "streams")


def load_all() -> None:
    """Import every area, which registers its queries."""
    for area in AREAS:
        import_module(f"docloom.plans.{area}")
