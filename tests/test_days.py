"""Replacing days as a whole, and read and write plans by bytes."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tonetape.sources import days, events, tables

MONDAY, TUESDAY, FRIDAY = dt.date(2016, 3, 7), dt.date(2016, 3, 8), dt.date(2016, 3, 4)


@pytest.fixture
def stored(frame, tmp_path):
    path = str(tmp_path / "out")
    tables.write_day_csv(frame([(1, "2016-03-04"), (2, "2016-03-07")], "n int, day string"), path)
    return path


def rows_of(spark, path):
    return sorted((r.n, str(r.day)) for r in spark.read.csv(path, header=True, schema="n int, day date").collect())


def test_a_write_that_fails_half_way_changes_nothing(spark, frame, stored):
    rows = frame([(3, "2016-03-04"), (4, "2016-03-07"), (0, "2016-03-08")], "n int, day string")
    broken = rows.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("half way")).cast("int")))
    with pytest.raises(Exception, match="half way"):
        tables.write_day_csv(broken.repartition(3, "n"), stored, days=[FRIDAY, MONDAY, TUESDAY])
    assert rows_of(spark, stored) == [(1, "2016-03-04"), (2, "2016-03-07")]


def test_days_are_replaced_as_a_whole(spark, frame, stored, tmp_path):
    tables.write_day_csv(frame([(5, "2016-03-07"), (6, "2016-03-08")], "n int, day string"), stored, days=[FRIDAY, MONDAY])
    assert rows_of(spark, stored) == [(5, "2016-03-07"), (6, "2016-03-08")]
    assert not [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("_swap")]


def test_a_rename_that_fails_puts_the_old_day_back(spark, frame, stored, monkeypatch):
    move = days.Files.move

    def fails(self, one, other):
        if "new" in one:
            raise OSError("no rename")
        move(self, one, other)

    monkeypatch.setattr(days.Files, "move", fails)
    with pytest.raises(OSError):
        tables.write_day_csv(frame([(9, "2016-03-04")], "n int, day string"), stored)
    assert rows_of(spark, stored) == [(1, "2016-03-04"), (2, "2016-03-07")]


def test_a_lost_swap_is_restored(spark, stored, tmp_path):
    aside = tmp_path / "out" / "_swap-lost" / "old"
    aside.mkdir(parents=True)
    (tmp_path / "out" / "day=2016-03-07").rename(aside / "day=2016-03-07")
    assert rows_of(spark, stored) == [(1, "2016-03-04")]
    assert days.restore_days(spark, stored) == ["day=2016-03-07"]
    assert rows_of(spark, stored) == [(1, "2016-03-04"), (2, "2016-03-07")]


def test_one_large_and_many_small_gzip_files(spark, tmp_path):
    """Small files share read tasks; only the large file's rows are dealt out, evenly."""
    line = lambda i: json.dumps({"stid": f"{i}", "companies": []})
    folder = tmp_path / "20160307"
    folder.mkdir()
    for i in range(500):
        (folder / f"small-{i}.log.gz").write_bytes(gzip.compress(line(i).encode()))
    (folder / "large.log.gz").write_bytes(gzip.compress("\n".join(map(line, range(1000, 31_000))).encode()))
    size = (folder / "large.log.gz").stat().st_size
    rows = events.read_sized(spark, str(folder), most=size // 2, bytes_per_task=size // 7)
    tasks = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 30_500 and len(tasks) < 40
    dealt = sorted(tasks)[-8:]
    assert dealt[0] > 3000 and max(dealt) < 1.3 * min(dealt)
    plain = events.read_sized(spark, str(folder), most=10 * size)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString() and plain.count() == 30_500
    sizes = events.file_sizes(spark, str(folder))
    assert sizes.count() == 501 and sizes.agg(F.max("bytes")).first()[0] == size


def test_files_of_even_size(spark, frame, tmp_path):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 18_000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    sizes = frame([("big", 1000), ("s0", 20), ("s1", 20), ("s2", None)], "source string, bytes long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are too few to stay apart
    try:
        back = tables.write_even(rows.repartition(16), str(tmp_path / "t"), "source", sizes, bytes_per_file=250)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert back.count() == 20_000
    files = {s: [spark.read.parquet(str(p)).count() for p in (tmp_path / "t" / f"source={s}").glob("part-*")] for s in ("big", "s0", "s1", "s2", "s3")}
    assert 2 <= len(files["big"]) <= 4 and sum(files["big"]) == 18_000
    assert all(len(files[s]) == 1 for s in ("s0", "s1", "s2", "s3"))
