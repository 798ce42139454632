"""Aggregate expressions with the null rules of the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def sum_or_zero(col: Column | str) -> Column:
    """Sum in which a group of nulls adds up to zero."""
    return F.coalesce(F.sum(_column(col)), F.lit(0))


def distinct_count(col: Column | str, count_null: bool = True) -> Column:
    """Number of distinct values; ``count_null`` counts null as one more value."""
    value = _column(col)
    known = F.count_distinct(value)
    if not count_null:
        return known
    return known + F.coalesce(F.max(value.isNull().cast("bigint")), F.lit(0).cast("bigint"))


def row_sum(cols: Sequence[Column | str]) -> Column:
    """Sum across columns of one row, nulls skipped."""
    return reduce(add, [F.coalesce(_column(c).cast("double"), F.lit(0.0)) for c in cols])


def _extreme_by(pick):
    def build(value: Column, order: Sequence[str]) -> Column:
        # Rows without a value do not compete, as the first/last *value* is asked for.
        ranked = F.when(value.isNotNull(), F.struct(*[F.col(o) for o in order], value.alias("_value")))
        return pick(ranked)["_value"]

    return build


AGGREGATES = {
    "sum": sum_or_zero,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
}

ORDERED_AGGREGATES = {"first": _extreme_by(F.min), "last": _extreme_by(F.max)}


def aggregate_by_name(name: str, col: str, order_by: Sequence[str] = ()) -> Column:
    """The aggregate a caller asked for by name; ``first`` and ``last`` need an explicit row order.

    ``median`` is not a plain expression here: see ``operators.grouping.median_by``.
    """
    if name in AGGREGATES:
        return AGGREGATES[name](F.col(col))
    if name in ORDERED_AGGREGATES:
        if not order_by:
            raise ValueError(f"{name!r} needs order_by: rows of a distributed table have no order")
        return ORDERED_AGGREGATES[name](F.col(col), order_by)
    raise ValueError(f"unknown aggregate: {name}")
