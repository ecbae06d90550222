"""Workload bindings: every registered query and its DuckDB oracle."""

from __future__ import annotations

import importlib

WORKLOADS = ["rounds", "loans", "forecast", "price", "digits"]


def all_queries() -> dict:
    out: dict = {}
    for w in WORKLOADS:
        try:
            mod = importlib.import_module(f"tessera.plans.{w}")
        except ModuleNotFoundError as exc:
            if exc.name == f"tessera.plans.{w}":
                continue
            raise
        out.update(mod.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for w in WORKLOADS:
        try:
            mod = importlib.import_module(f"tessera.plans.{w}")
        except ModuleNotFoundError as exc:
            if exc.name == f"tessera.plans.{w}":
                continue
            raise
        out.update(getattr(mod, "ORACLES", {}))
    return out
