"""Named queries over the given tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog():
    """All registered queries and their SQL checks."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    from trackloom.plans import catalog

    return catalog.QUERIES, catalog.ORACLE
