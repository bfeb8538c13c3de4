"""The most frequent values, exact in the end, from summaries that are kept per day and merged at need.

A summary holds the counts of a bounded number of values, with a bounded error however many values there
are, and summaries of days merge to those of any range. The frequent values of the merged summary are
candidates; only their rows are counted again. A value that is no candidate can't come more often than the
summary's error, so the answer is proven where the last place has more than that. Where it hasn't, all
values are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = 10_000
#: Fixed values of the frequent-items sketch: error times the size of its map over all counts; load of the map.
ERROR, LOAD = 3.5, 0.75


def summaries(rows: DataFrame, column: str, by: Iterable[str] = ("day",), *, items: int = ITEMS) -> DataFrame:
    """One row per group: how many values it has, and the summary of the most frequent ones. Nulls are left out."""
    known = rows.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("_value"))
    return known.groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(_value, {items})").alias("summary"))


def error_bound(n: int, items: int) -> int:
    """The largest count that a value may have and still not be among the candidates."""
    size = 1 << max(3, math.ceil(math.log2(items / LOAD)))
    return math.ceil(ERROR * n / size)


def top_values(rows: DataFrame, column: str, n: int, held: DataFrame, *, items: int = ITEMS) -> tuple[DataFrame, bool]:
    """The ``n`` most frequent values with their exact counts, equal counts by value, and whether the summaries proved it.

    ``held`` are the summaries of the groups that ``rows`` consists of. Two numbers come to the driver.
    """
    merged = held.agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(summary, {items})").alias("summary"))
    candidates = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {items})")).alias("c")).select(F.col("c.item").alias(column))
    first = _counted(rows.join(candidates, column, "left_semi"), column, n)
    total = held.agg(F.sum("n")).first()[0] or 0
    last = first.agg(F.count("*"), F.min("count")).first()
    if last[0] == n and last[1] > error_bound(total, items):
        return first, True
    return _counted(rows, column, n), False


def _counted(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)
