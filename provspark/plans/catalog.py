"""Registration of queries with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from provspark.plans.fixtures import Evidence, duck_with
from provspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", oracle: str | None = None):
    """Register ``fn(ev)`` under ``name``; ``needs`` names the derived tables its oracle SQL reads."""

    def wrap(fn: Callable[[Evidence], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Evidence(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = duck_with(needs, oracle)
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from provspark.plans import (  # noqa: F401
        queries_community,
        queries_evidence,
        queries_geometry,
        queries_matching,
        queries_reports,
        queries_web,
    )
