"""Every operator as a query over the driver tables, with its reference SQL."""

from cellgauge.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
