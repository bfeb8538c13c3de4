"""Spreading the rows of one join key over several groups, with the other side copied to each.

The salt is a hash of the row's own columns: the same again when a lost task is run anew.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def spread(rows: DataFrame, columns: Iterable[str], salts: int) -> DataFrame:
    _check(salts)
    return rows.withColumn(SALT, F.xxhash64(*columns).bitwiseAND(F.lit(salts - 1)))


def copied(rows: DataFrame, salts: int) -> DataFrame:
    _check(salts)
    return rows.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))


def _check(salts: int) -> None:
    if salts < 1 or salts & (salts - 1):
        raise ValueError("the number of salts must be a power of two")
