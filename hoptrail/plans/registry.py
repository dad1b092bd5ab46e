"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

import functools

from ..session import configure

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return keep
