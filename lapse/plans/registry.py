"""Registered queries: name -> (Spark plan builder, DuckDB oracle body or None).

Every builder takes (spark, sf_dir) and reads the test tables through the
fixture layers, so the work grows with the tables. Oracle bodies are run
after `oracle.prefix()`, which defines the same layers in DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lapse.plans import oracle

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, oracle_body: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, oracle_body)
        return fn
    return deco


def queries() -> dict[str, Builder]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: oracle.sql(v[1]) for k, v in REGISTRY.items() if v[1] is not None}


def _load() -> None:
    # importing the query modules fills REGISTRY
    from lapse.plans import queries_core, queries_decision, queries_eval, queries_io, queries_models  # noqa: F401
