"""Registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Adds a query (spark, sf_dir) -> DataFrame under a name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


for _part in ("radiometry", "tiles", "space", "rasters", "texts", "pipelines", "warps", "shapes", "pyramids"):
    importlib.import_module(f"rasterloom.plans.{_part}_queries")
