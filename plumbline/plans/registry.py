"""All queries of the measurement operators and the DuckDB SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from .views import Views, duck

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}  # query -> ids of the operator inventory


def query(ids: str, sql: str | None = None):
    """Register a function of Views under its own name; `sql` is its counterpart for DuckDB."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        COVERS[f.__name__] = ids
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return put


def FLAGSHIP(spark, sf_dir):
    return QUERIES["m13_verdicts"](spark, sf_dir)


from . import queries_cloud, queries_geo, queries_join, queries_measure, queries_more, queries_rest, queries_source, queries_stats  # noqa: E402,F401
