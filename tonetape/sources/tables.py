"""CSV inputs and the CSV, text and Parquet outputs. Paths may be of any Hadoop file system."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.functions.text import csv_line
from tonetape.schemas import STOCK_RETURN, TICKER_LIST, bin_sentiment
from tonetape.sources.days import Files, replace_days

STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless one-column CSV."""
    return spark.read.schema(TICKER_LIST).csv(path)


def read_returns(spark: SparkSession, path: str) -> DataFrame:
    """Returns as text, as they stand in the file; see ``returns.clean_returns``."""
    return spark.read.schema(STOCK_RETURN).csv(path, header=True)


def read_bin_sentiment(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.schema(schema or bin_sentiment()).csv(path, header=True, timestampFormat=STAMP_FORMAT)


def read_price_panel(spark: SparkSession, path: str, time: str = "Time") -> DataFrame:
    """Wide panel: the time column and one price column per ticker, named by the header.

    The names are read from the header line alone; all prices are read as double.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    schema = T.StructType([T.StructField(n, T.TimestampType() if n == time else T.DoubleType()) for n in names])
    return spark.read.schema(schema).csv(path, header=True, timestampFormat=STAMP_FORMAT)


def read_vectors(spark: SparkSession, path: str, *, text: tuple[str, ...] = ()) -> DataFrame:
    """Statement vectors: an index column first, then numbers, named by the header."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    kinds = [T.StringType() if i == 0 or n in text else T.DoubleType() for i, n in enumerate(names)]
    return spark.read.schema(T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])).csv(path, header=True)


def write_day_csv(
    rows: DataFrame,
    path: str,
    *,
    days: Iterable[dt.date] = (),
    day: str = "day",
    one_file: bool = False,
    header: bool = True,
    compression: str | None = None,
) -> None:
    """CSV under ``day=<day>/``; days written again, and all of ``days``, replace their old files once all is written.

    Tasks write what they hold. ``one_file`` brings each day's summary together in one task first:
    only for results as small as a day of bins.
    """
    out = rows.repartition(day) if one_file else rows

    def write(folder: str) -> None:
        out.write.partitionBy(day).csv(folder, header=header, compression=compression, timestampFormat=STAMP_FORMAT)

    replace_days(rows.sparkSession, path, write, days, day=day)


def write_csv(rows: DataFrame, path: str, *, header: bool = True, compression: str | None = None) -> None:
    """Plain CSV folder; ``compression`` as Spark names it: bzip2, gzip, none."""
    rows.write.mode("overwrite").csv(path, header=header, compression=compression, timestampFormat=STAMP_FORMAT)


def write_day_folders(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines in one plainly named folder per value of ``by``, as logs are delivered.

    Spark names such folders ``by=value``; they are written so and renamed.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).json(path, compression="gzip")
    files = Files(rows.sparkSession, path)
    for name in files.names():
        if name.startswith(f"{by}="):
            files.move((name,), (files.plain(name.split("=", 1)[1]),))


def write_file(rows: DataFrame, path: str) -> None:
    """One file of exactly the bytes in the only row's ``content``."""
    files = Files(rows.sparkSession, path)
    files.write(bytes(rows.first()["content"]))


def write_lines(rows: DataFrame, path: str) -> None:
    """Each row as one comma-joined text line, nulls as ``None``."""
    rows.select(csv_line(*(F.col(c) for c in rows.columns)).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, *, by: tuple[str, ...] = ()) -> DataFrame:
    """Write Parquet and read it back: a stored copy for results that are used several times.

    The whole table is replaced, also with ``by``.
    """
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_even(rows: DataFrame, path: str, by: str, sizes: DataFrame, *, bytes_per_file: int = 128 << 20) -> DataFrame:
    """Write Parquet by one column in files of even size, whatever the tasks before held, and read it back.

    ``sizes`` has the bytes to expect per value of ``by``, as ``events.file_sizes`` counts them. A value's rows
    are dealt out to so many tasks by a hash of the row; small values share tasks, none writes a file per task.
    """
    parts = sizes.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.sum("bytes") / bytes_per_file).alias("_parts"))
    known = rows.join(parts, F.col(by).eqNullSafe(F.col("_by")), "left")
    salt = F.pmod(F.xxhash64(*rows.columns), F.greatest(F.coalesce("_parts", F.lit(1)), F.lit(1)))
    dealt = known.withColumn("_part", salt).repartition(F.col(by), F.col("_part"))
    return write_table(dealt.select(*rows.columns), path, by=(by,))
