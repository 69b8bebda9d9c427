"""Registered queries: each name maps to a Spark plan and, where SQL can say it, a DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MODULES: list[str] = ["curation", "sampling", "relational", "text", "chess", "packing", "lineage"]


def _modules():
    import importlib

    return [importlib.import_module(f"quern.plans.{m}") for m in _MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable] = {}
    for m in _modules():
        out |= m.QUERIES
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.ORACLES
    return out
