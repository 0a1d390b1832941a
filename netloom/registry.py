"""Registered queries: name -> function of (spark, folder of tables), with the reference ids covered and an SQL oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = ["network", "names", "geometry", "state", "reports", "shapes", "lines", "solids", "drawings", "loops", "rewrites", "labels", "sinks", "totals"]


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    ops: tuple[str, ...]
    oracle: str | None


_FOUND: dict[str, Query] = {}


def query(ops: str, oracle: str | None = None):

    def add(fn):
        if fn.__name__ in _FOUND and _FOUND[fn.__name__].fn.__module__ != fn.__module__:
            raise ValueError(f"two queries named {fn.__name__}")
        _FOUND[fn.__name__] = Query(fn.__name__, fn, tuple(ops.split()), oracle)
        return fn

    return add


def all_queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"netloom.plans.{m}")
    return dict(_FOUND)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.fn for k, q in all_queries().items()}


def oracles() -> dict[str, str]:
    return {k: q.oracle for k, q in all_queries().items() if q.oracle}
