"""The registered queries, by module, with the SQL that checks them."""

from __future__ import annotations

from tidegraph.catalog import graph, imports, ledgers, pipeline, search, stores

MODULES = (graph, search, stores, ledgers, imports, pipeline)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
