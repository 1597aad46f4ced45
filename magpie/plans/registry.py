"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        def run(spark, sf_dir):
            from magpie.plans.fixtures import Tables

            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


from magpie.plans import index_queries, search_queries  # noqa: E402, F401
