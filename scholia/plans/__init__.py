"""Derived views, registered queries and their oracle statements."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every ``q_*`` module once; returns (queries, oracle)."""
    from scholia.plans import registry
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.startswith("q_"):
            importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLE
