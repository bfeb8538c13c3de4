import datetime as dt

import pytest
from pyspark.sql import functions as F

from tonetape.functions import clock, text


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def shown(column):
    return lambda v: column(v).cast("string")


def test_ticker_of(spark):
    assert values(spark, text.ticker_of, ["AAPL.O", "AAPL", "", None]) == ["AAPL", "AAPL", "", None]


def test_domain_label(spark):
    inputs = ["www.a.com", "bbc.co.uk", "localhost", None]
    assert values(spark, text.domain_label, inputs) == ["a", "co", None, None]


def test_host_of(spark):
    assert values(spark, text.host_of, ["https://www.a.com:80/x", "not a url"]) == ["www.a.com", None]


def test_parse_minute(spark):
    inputs = ["2016-03-08T12:34:56.7Z", "2016-03-08T12:34:56Z", "bad", None]
    assert values(spark, shown(clock.parse_minute), inputs) == ["2016-03-08 12:34:00"] * 2 + [None, None]


def test_parse_in_zone(spark):
    inputs = ["2016-03-08T12:34:56.7Z", "2016-03-08 12:34:56", "2016-07-08 12:00:00", "bad"]
    expected = ["2016-03-08 20:34:56", "2016-03-08 20:34:56", "2016-07-08 19:00:00", None]
    assert values(spark, shown(clock.parse_in_zone), inputs) == expected


def test_parse_plain(spark):
    assert values(spark, shown(clock.parse_plain), ["2016-03-08 12:34:56", "x"]) == ["2016-03-08 12:34:56", None]


def test_bin_end(spark):
    inputs = ["2016-03-08 12:00:00", "2016-03-08 12:14:00", "2016-03-08 12:15:00", "2016-03-08 23:50:00"]
    found = values(spark, lambda v: clock.bin_end(v.cast("timestamp")).cast("string"), inputs)
    assert found == ["2016-03-08 12:15:00", "2016-03-08 12:15:00", "2016-03-08 12:30:00", "2016-03-09 00:00:00"]


def test_floor_div_rounds_down(spark):
    assert values(spark, lambda v: clock.floor_div(v, 4), [7, 8, 0, -1, -4, -5], "bigint") == [1, 2, 0, -1, -1, -2]


def test_micros():
    assert clock.micros("15 minutes") == 900_000_000
    assert clock.micros(dt.timedelta(days=1)) == clock.DAY
    for wrong in ("0 hours", "soon", "3 fortnights"):
        with pytest.raises(ValueError):
            clock.micros(wrong)


def test_label(spark):
    found = values(spark, lambda v: clock.label(clock.day_start(dt.date(2016, 3, 8)), v), [85_500_000_000], "bigint")
    assert found == ["20160308-23:45:00"]


def test_weekdays(spark):
    days = clock.weekdays(dt.date(2016, 3, 4), dt.date(2016, 3, 7))
    assert days == [dt.date(2016, 3, 4), dt.date(2016, 3, 7)]
    assert len(clock.weekdays(dt.date(2016, 3, 4), dt.date(2016, 3, 7), weekends=True)) == 4
    found = values(spark, lambda v: clock.is_weekday(v.cast("date")), ["2016-03-07", "2016-03-26"])
    assert found == [True, False]


def test_csv_line(frame):
    rows = frame([("a", None, "b")], "x string, y string, z string")
    line = rows.select(text.csv_line(F.col("x"), F.col("y"), F.col("z"))).first()[0]
    assert line == "a,None,b"
