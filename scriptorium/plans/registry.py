"""Registry of named queries and their DuckDB oracle SQL.

``queries()`` maps a name to ``fn(spark, sf_dir) -> DataFrame``; ``oracles()``
maps the same name to a DuckDB SQL string over the supplied tables.  Queries
without an SQL form (file formats, iterative learning, streaming state) are
registered without one and are checked by tests instead.
"""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load():
    from .catalog import load_all

    load_all()


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
