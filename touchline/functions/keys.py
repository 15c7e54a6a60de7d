"""Joins on keys that may be NULL, and tests for missing numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join on columns of the same name where NULL equals NULL; the keys come back once, from the left."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def known(*values: "Column | str") -> Column:
    """All numbers are there: neither NULL nor NaN."""
    each = [F.col(v) if isinstance(v, str) else v for v in values]
    return reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in each])
