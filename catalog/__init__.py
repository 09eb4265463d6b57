"""Registered queries: each operator on the given tables, with an equal SQL text where
SQL can express it."""

from __future__ import annotations

from catalog import dims, enrich, growth, places, reports, statistics, texts, typed
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "dims", "enrich", "growth", "places", "reports", "statistics", "texts", "typed"]
