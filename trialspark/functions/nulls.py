"""Missing-value rules that differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def in_set(column: Column, values: Iterable) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def strict_sum(column: Column, where: Column | None = None) -> Column:
    """Sum that is NULL when any input is; zero over no rows.

    With ``where`` only those rows count as input, and a row whose condition is missing
    makes the sum missing too.
    """
    where = F.lit(True) if where is None else where
    missing = F.count_if(where.isNull() | (where & column.isNull()))
    return F.when(missing == 0, F.coalesce(F.sum(F.when(where, column)), F.lit(0)))


def strict(aggregate: Callable[[Column], Column], column: Column) -> Column:
    """An aggregate that is NULL when any input is."""
    return F.when(F.count(column) == F.count(F.lit(1)), aggregate(column))


def strict_mean(column: Column) -> Column:
    """Mean that is NULL when any input is."""
    return strict(F.avg, column)


def ratio(top: Column, bottom: Column) -> Column:
    """Division with 0/0 (and x/0) as NULL."""
    return F.try_divide(top, bottom)


def truth(column: Column) -> Column:
    """A condition with missing counted as false."""
    return F.coalesce(column, F.lit(False))


def same(left: Iterable[Column], right: Iterable[Column]) -> Column:
    """All column pairs equal, NULL matching NULL."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in zip(left, right)))
