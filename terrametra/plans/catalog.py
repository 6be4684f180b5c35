"""Collect the query modules."""

from __future__ import annotations

import importlib

from terrametra.plans.registry import ORACLES, QUERIES

MODULES = ["cleaning_queries", "rollup_queries", "window_queries", "join_queries", "model_queries", "source_queries", "stream_queries"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"terrametra.plans.{m}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
