"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lociframe.queries.views import Views, with_views
from lociframe.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}


def query(name: str, *operators: str, sql: str | None = None, views: str = ""):
    """

    sql reads the driver's tables and the named views, which are put in front of it as CTEs.
    """
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Views(configure(spark), sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        OPERATORS[name] = operators
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return register


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module
    for module in ("interval_queries", "sequence_queries", "evaluation_queries", "motif_queries", "dataset_queries", "plan_queries", "file_queries"):
        import_module(f"lociframe.queries.{module}")


load()
