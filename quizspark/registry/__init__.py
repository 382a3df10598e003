"""All registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("source_queries", "clean_queries", "metric_queries", "board_queries", "text_queries",
            "sample_queries", "validate_queries", "stream_queries")


def all_queries() -> list:
    found = []
    for name in _MODULES:
        found += importlib.import_module(f"quizspark.registry.{name}").R.queries
    names = [q.name for q in found]
    if len(names) != len(set(names)):
        raise ValueError("two queries share a name")
    return sorted(found, key=lambda q: q.name)
