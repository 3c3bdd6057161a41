"""Aggregates and arithmetic with explicit rules for missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _complete(c: Column, value: Column) -> Column:
    """``value`` when no row of the group is NULL in ``c``, else NULL."""
    return F.when(F.count(c) == F.count(F.lit(1)), value)


def strict_sum(c: ColumnLike) -> Column:
    """Sum that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return _complete(c, F.sum(c))


def strict_avg(c: ColumnLike) -> Column:
    """Mean that is NULL as soon as one input is NULL."""
    c = as_col(c)
    return _complete(c, F.avg(c))


def sum_or_zero(c: ColumnLike) -> Column:
    """Sum over the non-NULL inputs; 0 when there are none."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def weighted_avg(value: ColumnLike, weight: ColumnLike) -> Column:
    """sum(value * weight) / sum(weight); NULL when any value or weight is NULL."""
    v, w = as_col(value), as_col(weight)
    return F.try_divide(strict_sum(v * w), strict_sum(w))


def weight_where(condition: Column, weight: ColumnLike) -> Column:
    """Total weight of the rows meeting ``condition``; an unknown condition counts as unmet."""
    return F.sum(F.when(condition, as_col(weight)).otherwise(0))


def subset_avg(value: ColumnLike, condition: Column) -> Column:
    """Mean over the rows meeting ``condition``; NULL for an empty subset or a missing value."""
    v = as_col(value)
    inside = F.when(condition, v)
    return F.when(F.count_if(condition) == F.count(inside), F.avg(inside))


def count_distinct_with_null(c: ColumnLike) -> Column:
    """Number of distinct values, NULL being one of them."""
    c = as_col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def group_constant(c: ColumnLike) -> Column:
    """The single value a column takes in a group; the job fails if there are several."""
    c = as_col(c)
    differs = F.coalesce(F.min(c) != F.max(c), F.lit(False))
    return F.when(differs, F.raise_error("group value is not constant")).otherwise(F.max(c))


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division that is NULL for a zero denominator."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def zero_if_null(c: ColumnLike) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def at_least_zero(c: ColumnLike) -> Column:
    """Negative values become 0, NULL stays NULL."""
    c = as_col(c)
    return F.when(c < 0, F.lit(0.0)).otherwise(c)


def rounded(c: ColumnLike, places: int = 6) -> Column:
    return F.round(as_col(c).cast("double"), places)
