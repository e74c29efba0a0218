"""All registered queries and their SQL."""

from __future__ import annotations

from skilldemand.plans import basket_queries, source_queries, text_queries

MODULES = [basket_queries, text_queries, source_queries]


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
