"""End-to-end plans over the driver tables, each paired with an independent SQL statement."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every plan module and return the registered queries."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from tidemark.plans.catalog import QUERIES

    return QUERIES
