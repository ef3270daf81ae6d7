"""Set operations on ids, images and label vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack(*tables: DataFrame) -> DataFrame:
    """All rows of tables with unequal columns; missing ones are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def unique_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def remaining(df: DataFrame, taken: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys that are not taken, such as the training images of a fold."""
    return df.select(*on).distinct().join(taken, list(on), "left_anti")


def common(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys present in both tables."""
    return a.select(*on).intersect(b.select(*on))


def top_sorted(df: DataFrame, order: Sequence[str], n: int, ascending: bool = False) -> DataFrame:
    """The first ``n`` rows of a report; the order should end in a unique column."""
    return df.orderBy(*[F.asc(c) if ascending or i else F.desc(c) for i, c in enumerate(order)]).limit(n)
