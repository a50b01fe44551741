"""Registered queries: each binds operators to the driver tables, with its SQL check."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every ``*_queries`` module so that its queries are registered."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module.name}")
