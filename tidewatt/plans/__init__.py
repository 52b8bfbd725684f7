"""The registered queries, one module per category; each has QUERIES and ORACLE."""

from __future__ import annotations

import importlib
import pkgutil

MODULES = [m.name for m in pkgutil.iter_modules(__path__)]


def _gathered(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name, {})
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict:
    return _gathered("ORACLE")
