"""Operators that prepare text for language models. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("sentences", "neighbours", "splitting", "encoding", "near_copies", "scans", "packing", "mixing", "cut_texts")


def _all(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
