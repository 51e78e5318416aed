"""Queries over the given tables, one per operator, with SQL to compare against."""


def all_queries():
    """(queries, oracles), both keyed by query name."""
    from gradeloom.catalog import aggregates, expressions, io, models, streams  # noqa: F401
    from gradeloom.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
