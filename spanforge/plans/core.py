"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL over the views."""

    def add(fn: Callable) -> Callable:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = with_views(sql)
        return fn

    return add
