"""Registered queries over the shared tables and their SQL checks."""

from __future__ import annotations

from importlib import import_module

from panelyard.plans.registry import QUERIES, Query

GROUPS = (
    "text_queries", "contract_queries", "history_queries", "weather_queries", "spc_queries", "regime_queries", "mart_queries",
    "evaluation_queries", "model_queries",
)


def load_queries() -> dict[str, Query]:
    for group in GROUPS:
        import_module(f"panelyard.plans.{group}")
    return QUERIES
