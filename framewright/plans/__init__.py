"""Queries of the library over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("label_queries", "stats_queries", "window_queries", "surgery_queries", "function_queries", "source_queries", "stream_queries")


def load() -> None:
    """Register every query."""
    for name in MODULES:
        importlib.import_module(f"framewright.plans.{name}")
