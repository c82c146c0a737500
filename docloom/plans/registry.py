"""All queries of the engine by name, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the DuckDB SQL for its rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


from docloom.plans import analytics, answers, catalog, hybrid, lifecycle, regulations, relational, retrieval, stores, streams, structure, text  # noqa: E402, F401
