"""Registered queries bound to the shared tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_all():
    """Import every catalog module and return (queries, SQL checks)."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    from plumbline.catalog.base import ORACLES, REGISTRY

    return REGISTRY, ORACLES
