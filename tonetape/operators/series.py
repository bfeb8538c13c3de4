"""Row positions and row shifts in time-ordered series, without one task per series.

A series (a ticker's history, a whole panel) is cut twice: into blocks of time to number its rows,
then into chunks of equal row numbers to shift them. A chunk also gets the last rows of the chunk
before it, so shifts see across the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetape.functions.clock import floor_div, micros

CHUNK_ROWS = 4096


def with_position(
    rows: DataFrame, keys: list[str], time: str, *, block: str = "1 day", into: str = "position"
) -> DataFrame:
    """0-based place of each row in the time order of its key.

    Rows are counted per (key, block of time); only these counts are summed up along the key, and
    rows are numbered inside their block. With one row per key and minute, a day's block holds at
    most 1440 rows, and a key has one count per day. Rows of one key and time are ordered by a hash of the
    whole row, so that the layout of the data has no say. Rows without a time or a key go.
    """
    blocked = rows.withColumn("_block", floor_div(F.unix_micros(time), micros(block)))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count("*").alias("_rows"))
        .select(*keys, "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(time, F.xxhash64(*rows.columns))
    return (
        blocked.join(starts, [*keys, "_block"])
        .withColumn(into, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_block", "_start")
    )


def with_chunks(rows: DataFrame, reach: int, *, position: str = "position", size: int = CHUNK_ROWS) -> DataFrame:
    """Add ``_chunk`` and ``_own``: each row in its own chunk, the last ``reach`` ones also in the next."""
    if not 0 <= reach < size:
        raise ValueError("chunks must be longer than the reach")
    own = floor_div(F.col(position), size)
    late = F.pmod(F.col(position), F.lit(size)) >= size - reach
    chunks = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.select("*", F.explode(chunks).alias("_chunk")).withColumn("_own", F.col("_chunk") == own)


def drop_borrowed(rows: DataFrame) -> DataFrame:
    """Only each row's place in its own chunk."""
    return rows.filter("_own").drop("_own", "_chunk")


def chunk_order(keys: list[str], position: str = "position"):
    return Window.partitionBy(*keys, "_chunk").orderBy(position)


def with_lags(
    rows: DataFrame,
    keys: list[str],
    value: str,
    lags: dict[str, int],
    *,
    position: str = "position",
    size: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``name: value of that many rows earlier`` columns to rows that have a position."""
    order = chunk_order(keys, position)
    shifted = with_chunks(rows, max(lags.values()), position=position, size=size).select(
        "*", *(F.lag(value, k).over(order).alias(name) for name, k in lags.items())
    )
    return drop_borrowed(shifted)


def filled_forward(
    rows: DataFrame, keys: list[str], value: str, reach: int, *, position: str = "position", size: int = CHUNK_ROWS
) -> tuple[DataFrame, Column]:
    """Rows in chunks, and the value or else the last one before it, in whichever chunk that was.

    What a chunk takes over is the last value before its borrowed rows, found from one row per
    (key, chunk). The column is a window over ``chunk_order`` and holds for borrowed rows too.
    """
    known = F.when(F.col(value).isNotNull(), F.col(position))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, floor_div(F.col(position) + reach, size).alias("_chunk"))
        .agg(F.max_by(value, known).alias("_last"))
        .select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    )
    chunked = with_chunks(rows, reach, position=position, size=size).join(carried, [*keys, "_chunk"], "left")
    so_far = chunk_order(keys, position).rowsBetween(Window.unboundedPreceding, 0)
    return chunked, F.coalesce(F.last(value, ignorenulls=True).over(so_far), F.col("_carried"))
