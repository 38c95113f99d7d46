"""All runnable queries with their checking SQL."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("vectors", "graphs", "samples", "histories", "streams")


def load() -> SimpleNamespace:
    for name in MODULES:
        importlib.import_module(f"regatta.catalog.{name}")
    from regatta.catalog.base import ORACLES, QUERIES

    return SimpleNamespace(queries=QUERIES, oracles=ORACLES)
