"""Registered queries over the driver tables, each with its SQL oracle."""

from importlib import import_module

MODULES = ("profile_queries", "insight_queries", "model_queries")


def load() -> None:
    """Import the query modules; each registers its queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
