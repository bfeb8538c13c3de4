import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tonetape.operators import bins
from tonetape.plans import jobs
from tonetape.schemas import SHARE_EVENT
from tonetape.sources import events as event_source
from tonetape.sources import tables
from tonetape.streaming import binning

FRIDAY, TUESDAY = dt.date(2016, 3, 4), dt.date(2016, 3, 8)


def event(day, minute, *scores, ric="A.O", kind="click", domain="www.google.com"):
    return {
        "standardTimestamp": f"2016-03-{day:02d}T12:{minute:02d}:30.250Z",
        "mappedEvent": kind,
        "deviceType": "Tablet",
        "refDomain": domain,
        "url": "https://news.example.org/x",
        "companies": [{"count": "1", "ric": ric, "sentiment": "pos", "sentiment_score": str(s)} for s in scores],
    }


@pytest.fixture
def logs(tmp_path):
    folders = {
        "20160304": [event(4, m, 0.1 * m) for m in range(6)] + [event(7, 3, 1.0)],
        "20160305": [event(5, 1, *[0.5] * 9)],
        "20160307": [event(7, m, 0.5) for m in range(5)] + [event(7, 1, *[0.5] * 9, ric="ZZZ.O"), event(7, 20, *[0.5] * 4)],
    }
    for name, lines in folders.items():
        (tmp_path / "logs" / name).mkdir(parents=True)
        (tmp_path / "logs" / name / "part-0.log").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "list.csv").write_text("A\nB\n")
    return tmp_path


def test_daily_bins(spark, logs):
    report = jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, str(logs / "out"))
    assert [(str(r.day), r.rows, r.skipped) for r in report.orderBy("day").collect()] == [
        ("2016-03-04", 7, False),
        ("2016-03-07", 7, False),
        ("2016-03-08", 0, True),
    ]
    out = spark.read.csv(str(logs / "out"), header=True).orderBy("day").collect()
    assert [(str(r.day), r.TimeInterval, r.Ticker, r.sentiment_count, r.event_click_count) for r in out] == [
        ("2016-03-04", "2016-03-04 12:15:00", "A", "6", "6"),
        ("2016-03-07", "2016-03-07 12:15:00", "A", "5", "5"),
    ]
    assert float(out[0].sentiment_mean) == pytest.approx(0.25)


@pytest.mark.parametrize("rule", ["bin_start", "time_of_day", "lookback"])
def test_daily_rules_equal_one_run_per_day(spark, logs, rule):
    listed = tables.read_ticker_list(spark, str(logs / "list.csv"))
    jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, str(logs / rule), rule=rule, threshold=2)
    found = spark.read.csv(str(logs / rule), header=True).collect()
    one_day = {
        "bin_start": bins.bin_start_day_summary,
        "time_of_day": bins.bin_time_of_day_summary,
        "lookback": bins.lookback_summary,
    }[rule]
    expected = []
    for day in (FRIDAY, dt.date(2016, 3, 7)):
        rows = jobs.clean_events(event_source.read_events(spark, str(logs / "logs" / day.strftime("%Y%m%d"))), listed)
        expected += [(str(day), r.TimeStamp, r.Ticker, str(r.sentiment_count)) for r in one_day(rows, day, threshold=2).collect()]
    assert sorted((str(r.day), r.TimeStamp, r.Ticker, r.sentiment_count) for r in found) == sorted(expected) != []


def test_clean_manifest(spark, logs):
    names = [("20160304/part-0.log", "20160304part-0"), ("20160307/part-0.log", "20160307part-0")]
    stored = jobs.clean_manifest(spark, str(logs / "logs"), names, str(logs / "flat"))
    found = stored.groupBy("source").count().orderBy("source").collect()
    assert [tuple(r) for r in found] == [("20160304part-0", 7), ("20160307part-0", 18)]


def test_clean_events_schema(spark):
    raw = spark.createDataFrame([event(4, 7, 0.5, "bad")], SHARE_EVENT)
    cleaned = jobs.with_interval(jobs.clean_events(raw))
    assert cleaned.columns == [
        "company_count",
        "company_sentiment_score",
        "Ticker",
        *(f"is_event_{e}" for e in ("pview", "click", "search", "share")),
        "TimeStamp",
        "TimeInterval",
    ]
    (row,) = cleaned.collect()
    assert (row.TimeStamp, row.TimeInterval) == (dt.datetime(2016, 3, 4, 12, 7), dt.datetime(2016, 3, 4, 12, 15))


def test_slim_days_keep_weekends(spark, logs):
    jobs.slim_days(spark, str(logs / "logs"), FRIDAY, TUESDAY, str(logs / "slim"))
    found = spark.read.csv(str(logs / "slim")).groupBy("day").count().orderBy("day").collect()
    assert [(str(r.day), r["count"]) for r in found] == [("2016-03-04", 7), ("2016-03-05", 9), ("2016-03-07", 18)]
    assert all(p.name.endswith(".bz2") for p in (logs / "slim").glob("day=*/part-*"))


def test_statement_sets(frame):
    rows = frame(
        [(str(i), 9.0, float(i), 1.0, i % 3, 0.1 * (i - 20), 0.5) for i in range(60)],
        "_c0 string, zero double, one double, two double, Label int, ROE_excess_change double, ROE_change double",
    )
    train, test, names, ratio = jobs.statement_sets(rows, 0.1, ["ROE_change"], "ROE_excess_change", drop_middle=True, last_feature=2)
    assert (train.count(), test.count()) == (36, 4)
    assert names == ["one", "two", "ROE_change"]
    assert not {r._c0 for r in train.collect()} & {r._c0 for r in test.collect()}
    assert (ratio.first().rows, ratio.first().positive_ratio) == (40, 26 / 40)


def test_labelled_returns(spark, frame):
    raw = spark.createDataFrame([event(4, 1, 0.5), event(4, 2, 0.5), event(4, 1, 0.5, ric="B.O", domain="b.org")], SHARE_EVENT)
    stock = frame([("2016-03-04 12:01:00", "A", "0.5"), ("2016-03-04 12:02:00", "A", "-1")], "Lagged_Time string, variable string, Return string")
    found = jobs.labelled_returns(raw, stock).orderBy("TimeStamp").collect()
    assert [(r.Ticker, r.Return, r.Label, r.is_domain_google, r.is_device_Tablet, r.is_event_click) for r in found] == [
        ("A", 0.5, 1.0, 1, 1, 1),
        ("A", -1.0, 0.0, 1, 1, 1),
    ]
    literal = jobs.labelled_returns(raw, stock, domain_mode="literal")
    assert literal.agg(F.sum("is_domain_google")).first()[0] == 0


def test_local_clean(spark):
    raw = spark.createDataFrame([event(4, 1, 0.5), event(4, 2)], SHARE_EVENT)
    (row,) = jobs.local_clean(raw).collect()
    assert (row.companies_ric, row.companies_sentiment_score, row.companies_count, row.domain) == ("A.O", 0.5, 1.0, "news.example.org")
    assert row.standardTimestamp == dt.datetime(2016, 3, 4, 20, 1, 30)


def test_model_rows(frame):
    start = dt.datetime(2016, 3, 7)
    times = [start + dt.timedelta(minutes=15 * i) for i in range(100)]
    sentiment = frame(
        [(t, k, 0.1 * i, 0.2, 5, 1) for i, t in enumerate(times) for k in "AB"],
        "Time timestamp, Ticker string, sentiment_mean double, sentiment_std double, sentiment_count long, event_share_count long",
    )
    panel = frame([(t, 100.0 + i, 50.0 - 0.1 * i) for i, t in enumerate(times)], "Time timestamp, A double, B double")
    found = jobs.model_rows(sentiment, panel).collect()
    # 100 times, the first 40 skipped by the rolling average, the next 32 per ticker by the shifts.
    assert len(found) == 2 * (100 - 40 - 32)
    assert {(r.Ticker, r.return_sign) for r in found} == {("A", True), ("B", False)}
    assert {r.sentiment_count for r in found} == {200}


def test_streamed_bins_equal_the_batch(spark, logs, tmp_path):
    listed = spark.createDataFrame([("A",)], "Ticker string")
    raw = binning.stream_events(spark, str(logs / "logs" / "20160304"), files_per_trigger=1)
    query = binning.run_available(binning.stream_bins(raw, listed), str(tmp_path / "live"), str(tmp_path / "state"))
    query.awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "live")).collect()
    assert (row.TimeInterval, row.Ticker, row.sentiment_count) == (dt.datetime(2016, 3, 4, 12, 15), "A", 6)


def bins_of(spark, path):
    return sorted((str(r.day), r.sentiment_count) for r in spark.read.csv(path, header=True).collect())


def test_a_second_run_drops_what_is_gone(spark, logs):
    landed, out = str(logs / "landed"), str(logs / "out")
    run = lambda: jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, out, landed=landed)
    run()
    assert bins_of(spark, out) == [("2016-03-04", "6"), ("2016-03-07", "5")]
    # Friday shrinks below the threshold, Monday's folder goes.
    (logs / "logs" / "20160304" / "part-0.log").write_text("\n".join(json.dumps(event(4, m, 0.1)) for m in range(2)))
    (logs / "logs" / "20160307" / "part-0.log").unlink()
    (logs / "logs" / "20160307").rmdir()
    report = {str(r.day): (r.rows, r.skipped) for r in run().collect()}
    assert report == {"2016-03-04": (2, False), "2016-03-07": (0, True), "2016-03-08": (0, True)}
    assert not [p for p in (logs / "out").glob("day=*/*.csv")]


def test_a_failing_day_doesnt_stop_the_others(spark, logs):
    whole = gzip.compress("\n".join(json.dumps(event(8, m, 0.5)) for m in range(3000)).encode())
    (logs / "logs" / "20160308").mkdir()
    (logs / "logs" / "20160308" / "part-0.log.gz").write_bytes(whole[: len(whole) // 2])
    out = str(logs / "out")
    report = jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, out, spread=3).collect()
    assert {str(r.day): r.failed is None for r in report} == {"2016-03-04": True, "2016-03-07": True, "2016-03-08": False}
    assert bins_of(spark, out) == [("2016-03-04", "6"), ("2016-03-07", "5")]
    (failed,) = (r.failed for r in report if r.failed)
    assert "EOFException" in failed and "20160308/part-0.log.gz" in failed and "An error occurred" not in failed


def test_a_day_that_fails_keeps_what_it_had(spark, logs):
    landed, out = str(logs / "landed"), str(logs / "out")
    run = lambda: jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, out, landed=landed)
    run()
    whole = gzip.compress("\n".join(json.dumps(event(7, m, 0.5)) for m in range(3000)).encode())
    (logs / "logs" / "20160307" / "part-1.log.gz").write_bytes(whole[: len(whole) // 2])
    (logs / "logs" / "20160304" / "part-0.log").write_text("\n".join(json.dumps(event(4, m, 0.1)) for m in range(8)))
    report = {str(r.day): (r.rows, r.failed is None) for r in run().collect()}
    assert report == {"2016-03-04": (8, True), "2016-03-07": (0, False), "2016-03-08": (0, True)}
    assert bins_of(spark, out) == [("2016-03-04", "8"), ("2016-03-07", "5")]
    assert event_source.read_landed(spark, landed, FRIDAY, TUESDAY).groupBy("day").count().count() == 2


def test_report_needs_no_scan_of_the_events(spark, logs):
    (logs / "logs" / "20160304" / "part-1.log").write_text("{broken\n")
    report = jobs.daily_bins(spark, str(logs / "logs"), str(logs / "list.csv"), FRIDAY, TUESDAY, str(logs / "out"))
    assert "Scan parquet" not in report._jdf.queryExecution().executedPlan().toString()
    assert {str(r.day): (r.rows, r.bad_lines) for r in report.collect()}["2016-03-04"] == (8, 1)
    slim = jobs.slim_days(spark, str(logs / "logs"), FRIDAY, TUESDAY, str(logs / "slim"))
    assert {str(r.day): (r.rows, r.bad_lines, r.skipped) for r in slim.collect()} == {
        "2016-03-04": (8, 1, False),
        "2016-03-05": (1, 0, False),
        "2016-03-06": (0, 0, True),
        "2016-03-07": (7, 0, False),
        "2016-03-08": (0, 0, True),
    }


def test_manifest_counts_and_even_files(spark, logs):
    (logs / "logs" / "20160304" / "part-1.log").write_text("{broken\n" + json.dumps(event(4, 1, 0.5)))
    names = [("20160304/part-0.log", "a"), ("20160304/part-1.log", "a"), ("20160307/part-0.log", "b")]
    seen = Observation()
    jobs.clean_manifest(spark, str(logs / "logs"), names, str(logs / "flat"), seen=seen)
    assert seen.get == {"rows": 16, "bad_lines": 1}
    sizes = {r["source"]: r.bytes for r in event_source.manifest_sizes(spark, str(logs / "logs"), names).groupBy("source").agg(F.sum("bytes").alias("bytes")).collect()}
    assert sizes["b"] == (logs / "logs" / "20160307" / "part-0.log").stat().st_size
    assert all(len(list((logs / "flat" / f"source={s}").glob("part-*"))) == 1 for s in "ab")


def test_landing_keeps_other_days_on_any_session(spark, logs):
    landed = str(logs / "landed")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        for day in (FRIDAY, dt.date(2016, 3, 7)):
            event_source.land_events(event_source.read_days(spark, str(logs / "logs"), day, day), landed, [day])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    assert event_source.read_landed(spark, landed, FRIDAY, TUESDAY).count() == 14


def test_manifest_with_odd_names(spark, logs):
    folder = logs / "logs" / "20160304"
    (folder / "part 1+%20.log").write_text(json.dumps(event(4, 1, 0.5)))
    names = [("./20160304/part 1+%20.log", "a"), ("20160304/part 1+%20.log", "b"), ("20160307/part-0.log", "c")]
    found = event_source.read_manifest(spark, str(logs / "logs"), names).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in found} == {"a": 1, "b": 1, "c": 7}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        event_source.read_manifest(spark, str(logs / "logs"), [("20160304/none.log", "x")])
