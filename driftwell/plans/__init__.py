"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

FAMILIES = ["source", "daily", "baseline", "trend", "quality", "projection", "signal", "sync", "model", "compliance", "streaming"]


def load():
    from driftwell.plans import registry

    for name in FAMILIES:
        importlib.import_module(f"driftwell.plans.{name}_queries")
    return dict(registry.QUERIES), dict(registry.ORACLES)
