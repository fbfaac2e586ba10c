"""EXT-23, EXT-24: the registry of queries: name -> (builder, SQL). Builders take (spark, sf_dir)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULES = ["matching", "graphs", "points", "correspondences", "trajectories", "consensus", "experiments", "ledgers", "geometry", "hypotheses", "labels", "decisions", "sources", "fusion", "training"]


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"keelson.plans.{m}_queries")
