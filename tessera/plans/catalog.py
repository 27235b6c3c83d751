"""All registered queries; importing a module registers its queries."""

from __future__ import annotations

import importlib

from .registry import ORACLE_SQL, QUERIES

_MODULES = (
    "stats_queries",
    "chart_queries",
    "doc_queries",
    "rag_queries",
    "memory_queries",
    "profile_queries",
    "text_queries",
    "context_queries",
    "stream_queries",
)

for _m in _MODULES:
    importlib.import_module(f"{__package__}.{_m}")

__all__ = ["QUERIES", "ORACLE_SQL"]
