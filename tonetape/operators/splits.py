"""Train and test splits and folds that neither sort nor number the whole frame.

Random sides come from a seeded MD5 of the key, which other engines can compute too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HASH_BITS = 52  # a double holds the hash exactly
_LAST = 1 << 62
_FIRST = -(1 << 63)
_EXACT = 1 << 53  # below it a double holds every whole number
#: Relative rank error of the quantile sketch, as its inverse, and how many counts one task may sum up.
SKETCH, FEW = 10_000, 1 << 20
#: Cells that a class is dealt out to before its rows are numbered.
CELL_BITS = 16


def hash_spot(keys: Iterable[str], seed: int) -> Column:
    """52 bits of the MD5 of the seed and the keys, joined by colons; a missing key counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, _HASH_BITS // 4), 16, 10).cast("bigint")


def hash_split(
    rows: DataFrame, keys: Iterable[str], weights: dict[str, float], *, seed: int = 1014, into: str = "split"
) -> DataFrame:
    """Name a random side for each row from a hash of its key: the same on every run and layout."""
    names = list(weights)
    total = sum(weights.values())
    spot = hash_spot(keys, seed) / F.lit(float(1 << _HASH_BITS))
    side, edge = F.lit(names[-1]), 1.0
    for name in reversed(names[1:]):
        edge -= weights[name] / total
        side = F.when(spot < edge, F.lit(names[names.index(name) - 1])).otherwise(side)
    return rows.withColumn(into, side)


def stratified_folds(
    rows: DataFrame, keys: list[str], label: str, folds: int, *, seed: int = 1, into: str = "fold"
) -> DataFrame:
    """A fold number per row; every class, rows without a label included, is spread evenly over the folds.

    The rows of a class are taken in the order of a seeded hash of the key and dealt out in turn, so its
    fold sizes differ by one at most. Only counts per (class, hash cell) are summed up along a class; rows
    are numbered inside their cell, which holds one of 65,536 parts of the class.
    """
    cell, spot = "_cell", "_spot"
    placed = rows.withColumn(spot, hash_spot(keys, seed)).withColumn(cell, F.shiftright(spot, _HASH_BITS - CELL_BITS))
    earlier = Window.partitionBy("_class").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(F.col(label).alias("_class"), cell)
        .agg(F.count("*").alias("_rows"))
        .select("_class", F.col(cell).alias("_part"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(label, cell).orderBy(spot, *keys)
    same = placed[label].eqNullSafe(starts["_class"]) & (placed[cell] == starts["_part"])
    number = F.col("_start") + F.row_number().over(inside) - 1
    numbered = placed.join(starts, same).withColumn(into, F.pmod(number, F.lit(folds)).cast("int"))
    return numbered.drop(spot, cell, "_class", "_part", "_start")


def shuffled_split(
    rows: DataFrame, keys: list[str], portion: float, *, seed: int = 1, into: str = "is_test"
) -> DataFrame:
    """True for the first ``int(rows * portion)`` rows in the order of a seeded hash of the key."""
    first, last = _cut(rows, [_plain(hash_spot(keys, seed)), *_ties(rows, keys)], keys, portion)
    return _marked(rows, first, last, into)


def chronological_split(
    rows: DataFrame,
    *,
    time: str = "Time",
    ties: tuple[str, ...] = ("Ticker",),
    portion: float = 0.8,
    into: str = "is_train",
) -> DataFrame:
    """True for the first ``int(rows * portion)`` rows in time order, ties ordered by ``ties``.

    Rows without a time come last.
    """
    return _marked(rows, *_cut(rows, [_timed(time), *_ties(rows, ties)], ties, portion), into)


def chronological_sides(
    rows: DataFrame, *, time: str = "Time", ties: tuple[str, ...] = ("Ticker",), portion: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """The rows before and after the cut; the time of the cut reaches both scans as a literal."""
    first, last = _cut(rows, [_timed(time), *_ties(rows, ties)], ties, portion)
    before = _marked(rows.filter(first.reach[0]), first, last, "_side")
    after = _marked(rows.filter(first.reach[1]), first, last, "_side")
    return before.filter("_side").drop("_side"), after.filter("NOT _side").drop("_side")


class _Key(NamedTuple):
    """A key as whole numbers in its order, and conditions on it that a scan can use where there are such."""

    place: Column
    before: Callable[[int], Column]
    same: Callable[[int], Column]
    until: Callable[[int], Column]
    since: Callable[[int], Column]


class _First(NamedTuple):
    """``sure`` rows come first; of the ``tied`` ones, equal in all keys, only ``left`` in the order of ``order``."""

    sure: Column
    tied: Column
    reach: tuple[Column, Column]


class _Last(NamedTuple):
    left: int
    order: list[str]


def _plain(place: Column) -> _Key:
    return _Key(place, lambda v: place < v, lambda v: place == v, lambda v: place <= v, lambda v: place >= v)


def _timed(time: str) -> _Key:
    column = F.col(time)
    stamp = lambda v: F.timestamp_micros(F.lit(v))
    return _Key(
        F.coalesce(F.unix_micros(time), F.lit(_LAST)),
        lambda v: column.isNotNull() if v == _LAST else column < stamp(v),
        lambda v: column.isNull() if v == _LAST else column == stamp(v),
        lambda v: F.lit(True) if v >= _LAST else column <= stamp(v),
        lambda v: column.isNull() if v == _LAST else (column >= stamp(v)) | column.isNull(),
    )


def _ties(rows: DataFrame, names: Iterable[str]) -> list[_Key]:
    """The columns as whole numbers, as far as their kinds allow; texts by 21 bytes, nulls first."""
    keys = []
    for name in names:
        kind, column = rows.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            keys.append(_plain(F.coalesce(column.cast("bigint"), F.lit(_FIRST))))
        elif isinstance(kind, T.StringType):
            for start in (1, 8, 15):
                part = F.rpad(F.hex(F.substring(column.cast("binary"), start, 7)), 14, "0")
                keys.append(_plain(F.coalesce(F.conv(part, 16, 10).cast("bigint"), F.lit(_FIRST))))
            break
        else:
            break
    return keys


def _cut(rows: DataFrame, keys: list[_Key], order: Iterable[str], portion: float) -> tuple[_First, _Last]:
    """Where the first rows end, key by key: at a value of the first, among its rows at one of the second, and so on.

    A step is two scans: a mergeable quantile sketch brackets the value, then rows before the bracket are
    counted as one and those inside per value. Later steps read the rows of the value only. A handful of
    numbers come to the driver. Give this a stored table.
    """
    if not 0 < portion < 1:
        raise ValueError("portion must lie between 0 and 1")
    sure, same, part, left, n, reach = F.lit(False), F.lit(True), rows, None, 0, (F.lit(True), F.lit(True))
    for number, key in enumerate(keys):
        value, left, n = _value_at(part, key, portion if left is None else left / n, left)
        if value is None:
            return _First(F.lit(False), F.lit(False), reach), _Last(0, list(order))
        if not number:
            reach = key.until(value), key.since(value)
        sure = sure | (same & F.coalesce(key.before(value), F.lit(False)))
        same = same & F.coalesce(key.same(value), F.lit(False))
        if not left:
            return _First(sure, F.lit(False), reach), _Last(0, list(order))
        part = part.filter(key.same(value))
    return _First(sure, same, reach), _Last(left, list(order))


def _under(end: int) -> int:
    """No more than any whole number that a sketch, which holds doubles, gives back as ``end``."""
    return end if abs(end) < _EXACT else max(end - int(math.ulp(float(end))), _FIRST)


def _over(end: int) -> int:
    return -_under(-end) if end < 0 else min(end if end < _EXACT else end + int(math.ulp(float(end))), -_FIRST - 1)


def _value_at(part: DataFrame, key: _Key, share: float, rank: int | None) -> tuple[int | None, int, int]:
    """The value of the row of that rank (or share), how many rows of the value come before it, and how many it has."""
    rows = part.withColumn("_at", key.place)
    while True:
        ends = [max(0.0, share - 2 / SKETCH), min(1.0, share + 2 / SKETCH)]
        seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("_at", ends, SKETCH).alias("ends")).first()
        n = seen["n"]
        if not n:
            return None, 0, 0
        if rank is None:
            rank = int(n * share)
        (low, high), one = seen["ends"], seen["ends"][0] == seen["ends"][1]
        low, high = _under(low), _over(high)
        if one or n * 4 / SKETCH <= FEW:
            break
        inside = rows.filter(key.until(high)).agg(F.count_if(key.place < low).alias("below"), F.count_if(key.place >= low).alias("n")).first()
        if inside["n"] > n / 2:  # a few values hold most rows: counts per value are few
            break
        rows, rank = rows.filter(key.until(high) & (key.place >= low)), rank - inside["below"]
        share = rank / inside["n"]
    earlier = Window.partitionBy().orderBy(F.asc_nulls_first("_key")).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.filter(key.until(high)).groupBy(F.when(F.col("_at") >= low, F.col("_at")).alias("_key")).agg(F.count("*").alias("_n"))
    found = (
        counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .filter(F.col("_key").isNotNull() & (F.col("_before") <= rank) & (F.col("_before") + F.col("_n") > rank))
        .first()
    )
    if found is None:
        raise RuntimeError("the rows changed between two scans")
    return found["_key"], rank - found["_before"], found["_n"]


def _marked(rows: DataFrame, first: _First, last: _Last, into: str) -> DataFrame:
    if not last.left:
        return rows.withColumn(into, first.sure)
    numbered = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*last.order))
    shared = rows.filter(first.tied).withColumn(into, numbered <= last.left)
    return rows.filter(~first.tied).withColumn(into, first.sure).unionByName(shared)
