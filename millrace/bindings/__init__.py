"""Operators bound to the provided tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib

MODULES = ["equations", "links", "filters", "aggregates", "series", "cleaning", "masters", "multivariate", "flows"]


def _registries():
    return [importlib.import_module(f"millrace.bindings.{m}").R for m in MODULES]


def all_queries() -> dict:
    merged: dict = {}
    for registry in _registries():
        for name, query in registry.queries.items():
            if name in merged:
                raise ValueError(f"query {name} registered twice")
            merged[name] = query
    return merged


def all_sql() -> dict[str, str]:
    return {name: sql for registry in _registries() for name, sql in registry.sql.items()}


def flagship(spark, folder: str):
    from millrace.bindings.links import flagship as build

    return build(spark, folder)
