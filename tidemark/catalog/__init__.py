"""Registered queries over the sample tables, each with its check in SQL."""

from __future__ import annotations

import importlib

from . import base

MODULES = ["market", "outcomes", "snapshots", "views", "books", "fundamentals", "pages", "ranker", "maintenance", "landed", "streams", "timed"]


def load() -> tuple[dict, dict]:
    """All queries and checks."""
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return base.QUERIES, base.CHECKS
