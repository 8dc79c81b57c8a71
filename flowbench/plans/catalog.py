"""Registry of named queries: each has a Spark plan and, where SQL can say it, an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Registers a plan under a name, with its SQL check if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


# Every module that registers queries.
MODULES = ("profile", "cleaning", "splits", "metrics", "results", "learners", "streams", "artefacts")


def load_all() -> None:
    """Imports the modules that register queries."""
    for name in MODULES:
        import_module(f"flowbench.plans.queries_{name}")
