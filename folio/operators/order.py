"""Order statistics by group, exact, without a list of the group.

Equal values are counted before they are shuffled; the value in question is where the
running count of a group's distinct values passes its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistic(rows: DataFrame, by: list[str], value: str, place: Callable[[Column], Column], name: str) -> DataFrame:
    """(by..., name): the value that `place`, given a group's number of values, counts from 0 in their order.

    Nulls are no values; groups without values, or with fewer than their place asks for, have no row.
    """
    group = Window.partitionBy(*by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumns({"__upto": upto, "__at": place(F.sum("__n").over(group))})
    return counts.where("__at >= __upto - __n AND __at < __upto").select(*by, F.col("__v").alias(name))


def upper_medians(rows: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by..., name): the upper of the two middle values of each group."""
    return order_statistic(rows, by, value, lambda n: F.floor(n / 2), name)


def upper_median_over(value: Column, group, order: str = "__ranked") -> tuple[Column, Callable[[str], Column]]:
    """For groups that a window lays out already: a rank to add as a column `order`, and the median by it."""
    rank = F.row_number().over(group.orderBy(value.asc_nulls_last()))
    return rank, lambda column: F.max(F.when(F.col(order) == F.floor(F.count(column).over(group) / 2) + 1, F.col(column))).over(group)
