"""Registered queries and their DuckDB counterparts."""

from .plans import catalog, formats, physics, vision


def queries():
    assert formats and physics and vision
    return dict(catalog.QUERIES)


def oracle_sql():
    assert formats and physics and vision
    return dict(catalog.SQL)
