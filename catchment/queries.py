"""Query registry: one entry per operator of the inventory.

``QUERIES[name](spark, sf_dir) -> DataFrame`` builds the operator on the data
folder's tables; ``ORACLES[name]`` is the independent SQL for the same result
(see ``catchment.oracle``).  Both sides present the same columns with the same
rounding (``catchment.present``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle as O
from .present import present

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, columns: list[str] | None, sql: str | None):
    """Register a query; ``columns`` fixes the output columns (and rounding),
    ``sql`` is the oracle body (None: no SQL form)."""

    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), columns)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = O.oracle(sql, columns)
        return run

    return deco


# Importing the query modules fills the registry.
from .plans import q_attraction, q_competition, q_features, q_profiles, q_sinks  # noqa: E402,F401
