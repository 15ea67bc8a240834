"""Named queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("vector_queries", "text_queries", "corpus_queries", "language_queries", "model_queries", "stream_queries", "understanding_queries")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
