"""Grouped kernels over plain rows, for semantics that depend on the order of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Rows = Iterable[dict]


def _table(rows: Rows, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


def per_group(df: DataFrame, keys: list[str], kernel: Callable[[list[dict]], Rows], schema: str | T.StructType) -> DataFrame:
    """kernel(rows of a group) -> rows; the group's keys are among the rows' fields."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    return df.groupBy(*keys).applyInArrow(lambda table: _table(kernel(table.to_pylist()), arrow), out)


def per_pair(left: DataFrame, right: DataFrame, keys: list[str], kernel: Callable[[list[dict], list[dict]], Rows], schema: str | T.StructType) -> DataFrame:
    """kernel(rows of a group on the left, on the right) -> rows; either may be empty."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)
    right = right.toDF(*right.columns)  # the two may come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _table(kernel(a.to_pylist(), b.to_pylist()), arrow), out)


def nearest(items: Iterable, distance: Callable, limit: float, last: bool = False):
    """The item at the least distance below the limit (at it, too, where the last of equals wins)."""
    best, least = None, limit
    for item in items:
        d = distance(item)
        if d is not None and (d <= least if last else d < least):
            best, least = item, d
    return best
