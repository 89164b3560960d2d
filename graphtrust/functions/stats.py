"""Guarded statistics that agree with their textbook definitions on degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fixed(x: Column, digits: int = 6) -> Column:
    """Rounded half up in plain double arithmetic, so that any engine gives the same."""
    return F.floor(x * float(10**digits) + 0.5) / float(10**digits)


def pearson(x: Column, y: Column) -> Column:
    """Aggregate; 0 where there are fewer than two rows or no variance."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-15, spread)), F.lit(0.0))


def zscore(x: Column, sample: bool = False) -> Column:
    """Over all rows; 0 without variance. For tables of communities, which are small."""
    every = Window.partitionBy()
    clean = F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    std = (F.stddev_samp if sample else F.stddev_pop)(clean).over(every)
    return F.when(F.coalesce(std, F.lit(0.0)) > 1e-15, (clean - F.avg(clean).over(every)) / std).otherwise(0.0)


def average_rank(x: str, descending: bool = False) -> Column:
    """Ranks from 1, equals sharing their mean."""
    order = F.col(x).desc() if descending else F.col(x).asc()
    return F.rank().over(Window.orderBy(order)) + (F.count("*").over(Window.partitionBy(x)) - 1) / 2.0


def percent_rank(x: str) -> Column:
    return average_rank(x) / F.count("*").over(Window.partitionBy())


def mean_of(*columns: Column) -> Column:
    return sum(columns[1:], columns[0]) / float(len(columns))


def upper_median(x: str) -> Column:
    """Aggregate: sorted[n // 2] of whole numbers. Counts by distinct values are merged, not the values themselves."""
    return F.expr(f"CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC) AS BIGINT)")
