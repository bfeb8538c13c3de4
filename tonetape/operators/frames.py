"""Joining frames of unlike columns, checks, and cleaning for model input."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames, columns matched by name and filled with null where missing."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _missing(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def null_counts(rows: DataFrame) -> DataFrame:
    """One row: how many nulls (or NaNs) each column holds."""
    return rows.select(*(F.count_if(_missing(f)).alias(f.name) for f in rows.schema))


def require_complete(rows: DataFrame) -> DataFrame:
    """The same rows; raises if any column holds a null."""
    found = {name: n for name, n in null_counts(rows).first().asDict().items() if n}
    if found:
        raise ValueError(f"missing values: {found}")
    return rows


def model_frame(
    vectors: DataFrame,
    *,
    drop_middle: bool = False,
    label: str = "Label",
    signs: tuple[str, ...] = ("ROE_excess_change", "ROE_change"),
) -> DataFrame:
    """Complete rows, optionally without the middle class 2, plus ``<change>_sign`` columns."""
    kept = vectors.filter(F.col(label) != 2) if drop_middle else vectors
    return kept.na.drop("any").withColumns({f"{c}_sign": F.col(c) > 0 for c in signs})


def feature_names(
    rows: DataFrame, first: int, last: int, extra: Iterable[str] = (), *, index: str | None = None
) -> list[str]:
    """Columns at positions ``first`` to ``last``, both included, and the extra ones.

    Positions count from 0 and leave out the ``index`` column, if one is named.
    """
    columns = [c for c in rows.columns if c != index]
    return [*columns[first : last + 1], *extra]


def features_except(rows: DataFrame, *others: str) -> list[str]:
    return [c for c in rows.columns if c not in others]
