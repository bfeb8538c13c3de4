"""Share-event logs: line-delimited JSON, plain or gzip, in one folder per day or by manifest."""

from __future__ import annotations

import datetime as dt
import posixpath
import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.functions.clock import weekdays
from tonetape.operators import frames
from tonetape.schemas import SHARE_EVENT
from tonetape.sources.days import counts_of, observed, reason, replace_days, restore_days, unreadable

BAD_LINE = "_corrupt_record"
#: Signs that a path pattern would read as more than themselves.
GLOB_SIGNS = r"[\[\]{}*?\\]"


def read_events(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType = SHARE_EVENT,
    *,
    spread: int | None = None,
    bad_lines: bool = False,
) -> DataFrame:
    """Events of the paths or globs, in a fixed schema: no pass over the data to infer one.

    A gzip file cannot be split, so few large ones make few tasks; ``spread`` deals their rows out
    to that many partitions. With ``bad_lines`` unreadable lines are kept in ``_corrupt_record``;
    otherwise they come as rows of nulls.
    """
    wanted = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())]) if bad_lines else schema
    rows = (
        spark.read.schema(wanted)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD_LINE)
        .json(paths)
        .select("*", F.col("_metadata.file_path").alias("source_path"))
    )
    return rows.repartition(spread) if spread else rows


def read_days(
    spark: SparkSession,
    root: str,
    first: dt.date,
    last: dt.date,
    schema: T.StructType = SHARE_EVENT,
    *,
    weekends: bool = False,
    files: str | None = None,
    spread: int | None = None,
    bad_lines: bool = False,
) -> DataFrame:
    """Events of the folders ``root/yyyyMMdd`` of the range, both ends in, with their ``day``.

    One scan for the whole range. Saturdays and Sundays are not even listed unless asked for; days
    without a folder are left out (see ``day_report``). Only the folders are matched on the driver,
    their files are listed by the cluster, unless ``files`` names a pattern of files to take.
    """
    names = ",".join(d.strftime("%Y%m%d") for d in weekdays(first, last, weekends=weekends))
    path = f"{root.rstrip('/')}/{{{names}}}" + (f"/{files}" if files else "")
    try:
        rows = read_events(spark, path, schema, spread=spread, bad_lines=bad_lines)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        extra = [T.StructField(BAD_LINE, T.StringType())] if bad_lines else []
        rows = frames.empty(spark, T.StructType([*schema.fields, *extra, T.StructField("source_path", T.StringType())]))
    folder = F.element_at(F.split("source_path", "/"), F.lit(-2))
    return rows.withColumn("day", F.try_to_date(folder, "yyyyMMdd"))


def day_report(rows: DataFrame, first: dt.date, last: dt.date, *, weekends: bool = False) -> DataFrame:
    """Per wanted day: rows read, unreadable lines, and whether it was skipped for want of data.

    ``rows`` were read with ``bad_lines`` and landed, so that the logs are not parsed again for this.
    """
    wanted = rows.sparkSession.createDataFrame([(d,) for d in weekdays(first, last, weekends=weekends)], "day date")
    seen = rows.groupBy("day").agg(F.count("*").alias("rows"), F.count(BAD_LINE).alias("bad_lines"))
    return wanted.join(seen, "day", "left").select(
        "day",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce("bad_lines", F.lit(0)).alias("bad_lines"),
        F.col("rows").isNull().alias("skipped"),
    )


def _manifest_paths(spark: SparkSession, root: str, files: Iterable[str]) -> tuple[list[str], int]:
    """The files' qualified paths with signs of patterns escaped, and where in a path a file's own name starts."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(str(root))
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder)
    paths = [f"{base.toString().rstrip('/')}/{re.sub(GLOB_SIGNS, lambda m: chr(92) + m[0], file)}" for file in files]
    return paths, len(base.toUri().getPath().rstrip("/")) + 2


def _own_name(path: str, start: int) -> Column:
    """A file's name below the root. Paths come URL-encoded, where a plus sign is itself."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.substr(F.regexp_replace(plain, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit(start))


def _pairs(names: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    return sorted({(posixpath.normpath(file), source) for file, source in names})


def read_manifest(
    spark: SparkSession,
    root: str,
    names: Iterable[tuple[str, str]],
    schema: T.StructType = SHARE_EVENT,
    *,
    spread: int | None = None,
    bad_lines: bool = False,
) -> DataFrame:
    """Events of the listed (input file, output name) pairs in one scan, tagged with ``source``, the output name.

    Files are named relative to ``root`` and may lie at any depth. A file listed under two names is read
    once and comes once per name; a file that isn't there raises, and so does one that isn't found in the list.
    """
    pairs = _pairs(names)
    paths, start = _manifest_paths(spark, root, sorted({file for file, _ in pairs}))
    rows = read_events(spark, paths, schema, spread=spread, bad_lines=bad_lines)
    listed = spark.createDataFrame(pairs, "file string, source string")
    found = rows.withColumn("file", _own_name("source_path", start)).join(listed, "file", "left")
    # A file that was read and isn't found in the list would vanish without a word.
    unknown = F.raise_error(F.concat(F.lit("not a listed file: "), F.col("file"))).cast("string")
    return found.withColumn("source", F.coalesce("source", unknown)).drop("file")


def manifest_sizes(spark: SparkSession, root: str, names: Iterable[tuple[str, str]]) -> DataFrame:
    """(source, bytes) of every listed pair."""
    pairs = _pairs(names)
    paths, start = _manifest_paths(spark, root, sorted({file for file, _ in pairs}))
    # A listing gives plain paths, which are not to be decoded.
    plain = F.regexp_replace("file", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    sizes = file_sizes(spark, paths).select(F.substr(plain, F.lit(start)).alias("file"), "bytes")
    return sizes.join(spark.createDataFrame(pairs, "file string, source string"), "file").select("source", "bytes")


def file_sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, folder, bytes) of all files of the paths or globs, listed by the cluster; none is opened."""
    listed = spark.read.format("binaryFile").load(paths)
    return listed.select(
        F.col("path").alias("file"), F.element_at(F.split("path", "/"), F.lit(-2)).alias("folder"), F.col("length").alias("bytes")
    )


def read_sized(
    spark: SparkSession,
    paths: str | list[str],
    schema: T.StructType = SHARE_EVENT,
    *,
    most: int = 256 << 20,
    bytes_per_task: int = 32 << 20,
    bad_lines: bool = False,
) -> DataFrame:
    """Events of paths that hold gzip files of very different sizes.

    Small files are packed into read tasks by Spark itself, largest first. A gzip file of more than ``most``
    bytes can't be split and would keep one task busy to the end: only the rows of such files are dealt out
    after reading, to as many tasks as their bytes ask for.
    """
    packed = F.lower("file").rlike(r"\.gz(ip)?$") & (F.col("bytes") > most)
    large = file_sizes(spark, paths).filter(packed).agg(F.sum("bytes")).first()[0]
    rows = read_events(spark, paths, schema, bad_lines=bad_lines)
    if not large:
        return rows
    is_large = F.lower("_metadata.file_path").rlike(r"\.gz(ip)?$") & (F.col("_metadata.file_size") > most)
    wanted = T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())]) if bad_lines else schema
    reader = spark.read.schema(wanted).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    few, many = (
        reader.json(paths).filter(side).select("*", F.col("_metadata.file_path").alias("source_path")) for side in (is_large, ~is_large)
    )
    return many.unionByName(few.repartition(-(-large // bytes_per_task)))


def land_events(rows: DataFrame, path: str, days: Iterable[dt.date] = ()) -> None:
    """Store a day range once as Parquet by ``day``; ``days``, and those written again, replace their old files
    when all is written."""
    replace_days(rows.sparkSession, path, lambda folder: rows.write.partitionBy("day").parquet(folder), days)


def land_range(
    spark: SparkSession,
    read: Callable[[dt.date, dt.date], DataFrame],
    path: str,
    days: list[dt.date],
    *,
    batch: int = 30,
    side_by_side: int = 4,
) -> dict[dt.date, tuple[int, int] | str]:
    """Land a range of days and count rows and unreadable lines per day on the way.

    Some ``batch`` days are one job, a few jobs run side by side. If a file of a batch can't be read, its days
    are landed one by one, also side by side; a day that still fails keeps what was landed of it before, and
    comes with the reason in place of the counts. Only failures of a file's reading are taken so.
    """

    def land(some: list[dt.date]) -> dict[dt.date, tuple[int, int] | str]:
        rows, seen = observed(read(some[0], some[-1]), some, BAD_LINE)
        try:
            land_events(rows, path, some)
        except Exception as error:
            if not unreadable(error):
                raise
            return {some[0]: reason(error)} if len(some) == 1 else {}
        return counts_of(seen, some)

    restore_days(spark, path)
    found: dict[dt.date, tuple[int, int] | str] = {}
    with ThreadPoolExecutor(side_by_side) as pool:
        task = inheritable_thread_target(spark)(land)
        for done in pool.map(task, [days[i : i + batch] for i in range(0, len(days), batch)]):
            found |= done
        for done in pool.map(task, [[d] for d in days if d not in found]):
            found |= done
    return found


def range_report(spark: SparkSession, landed: dict[dt.date, tuple[int, int] | str]) -> DataFrame:
    """Per day: rows read, unreadable lines, whether it was skipped for want of data, and why it failed."""
    rows = [
        (d, 0, 0, False, told) if isinstance(told, str) else (d, *told, not told[0], None) for d, told in sorted(landed.items())
    ]
    return spark.createDataFrame(rows, "day date, rows bigint, bad_lines bigint, skipped boolean, failed string")


def read_landed(spark: SparkSession, path: str, first: dt.date, last: dt.date, schema: T.StructType | None = None) -> DataFrame:
    """Landed events of the days of the range; other days' folders are not read.

    ``schema`` lets a range without any row be read.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).filter(F.col("day").between(first, last))
