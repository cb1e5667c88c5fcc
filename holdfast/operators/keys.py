"""Keyed building blocks: newest row, first n rows, running totals over ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of every key in a total order.

    The rank filter lets Spark put a group limit before the exchange, so each
    map task ships at most ``n`` rows per key however large the key is.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return first_n_per_key(df, keys, order, 1)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def after(order: list[tuple[str, bool]], last: dict) -> Column:
    """Whether a row comes after ``last`` in a total order of (column, descending), nulls first upwards and last downwards.

    Its first part speaks of the leading column alone, so the scan can skip what lies before it.
    """

    def beyond(name: str, descending: bool, or_same: bool = False) -> Column:
        c, value = F.col(name), F.lit(last[name])
        if last[name] is None:
            found = F.lit(False) if descending else c.isNotNull()
            return found | c.isNull() if or_same else found
        if descending:
            return (c <= value if or_same else c < value) | c.isNull()
        return c >= value if or_same else c > value

    out, same = F.lit(False), F.lit(True)
    for name, descending in order:
        out = out | (same & beyond(name, descending))
        same = same & F.col(name).eqNullSafe(F.lit(last[name]))
    return beyond(*order[0], or_same=True) & out


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """The ``size`` rows that follow ``last``, the last row of the page before (none: the first page).

    Each task and the driver keep ``size`` rows however far the page is from the start.
    """
    if size < 1:
        raise ValueError("page size starts at 1")
    rows = df if last is None else df.filter(after(order, last))
    return rows.orderBy(*(F.col(n).desc() if descending else F.col(n).asc() for n, descending in order)).limit(size)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order."""
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
