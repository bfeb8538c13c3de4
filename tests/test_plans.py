"""What the plans must look like whatever the data: exchanges, pruning, and keys that split hot groups."""

import datetime as dt
import re

import pytest

from tonetape.operators import bins, companies, returns, rolling, splits, thresholds
from tonetape.plans import stand_ins as data
from tonetape.sources import events as event_source

FOLDER = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 5)


def physical(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def exchanges(rows):
    return len(re.findall(r"\bExchange ", physical(rows)))


@pytest.fixture
def events(spark):
    return data.sentiment_events(spark, FOLDER)


def test_one_exchange_per_binning(events):
    rules = {"events": data.EVENT_KINDS}
    assert exchanges(bins.bin_end_summary(events, **rules)) == 1
    assert exchanges(bins.bin_start_day_summary(events, DAY, **rules)) == 1
    assert exchanges(bins.bin_time_of_day_summary(events, DAY, **rules)) == 1
    assert exchanges(bins.lookback_summary(events, DAY, **rules)) == 2


def test_bins_aggregate_before_the_exchange(events):
    plan = physical(bins.bin_end_summary(events, events=data.EVENT_KINDS))
    assert plan.index("Exchange") < plan.index("partial_avg")


def test_scan_reads_only_what_is_used(events):
    plan = physical(bins.bin_end_summary(events, events=data.EVENT_KINDS))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan


def test_day_start_reaches_the_scan(spark, tmp_path):
    data.sentiment_events(spark, FOLDER).write.parquet(str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert "PushedFilters: [IsNotNull(TimeStamp), GreaterThanOrEqual(TimeStamp" in physical(
        bins.bin_start_day_summary(stored, DAY, events=data.EVENT_KINDS)
    )


def test_other_days_are_not_read(spark, tmp_path, frame):
    path = str(tmp_path / "landed")
    event_source.land_events(frame([("a", "2024-01-05"), ("b", "2024-01-08")], "stid string, day string"), path)
    plan = physical(event_source.read_landed(spark, path, DAY, DAY))
    assert re.search(r"PartitionFilters: \[.*day.*2024-01-05", plan)


def test_windows_and_joins_are_keyed_to_split_hot_tickers(spark, frame):
    stored = data.bin_sentiment(spark, FOLDER)
    assert re.search(r"Window .*windowspecdefinition\(Ticker#\d+, stretch", physical(rolling.rolling_weighted_sentiment(stored)))
    rows = stored.select("Time", "Ticker", stored["sentiment_mean"].alias("Return_h_60"))
    assert re.search(r"lag\(.*windowspecdefinition\(Ticker#\d+, _chunk", physical(returns.lag_delta_features(rows)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        events = frame([(1, "2024-01-05", "A")], "id int, TimeStamp string, Ticker string", ["TimeStamp"])
        stock = frame([("2024-01-05", "A", 0.5)], "TimeStamp string, Ticker string, Return double", ["TimeStamp"])
        assert re.search(r"Exchange hashpartitioning\(TimeStamp#\d+, Ticker#\d+, _salt", physical(returns.label_events(events, stock, salts=4, salt_by=("id",))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lists_are_left_to_sparks_size_check(spark, events):
    listed = spark.createDataFrame([("view",), ("click",), ("view",)], "Ticker string")
    found = companies.keep_listed(events, listed)
    assert "left_semi" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("leftsemi", "left_semi")
    assert sorted(found.columns) == sorted(events.columns) and found.count() > 0


def test_sweep_scans_once(spark):
    assert physical(thresholds.threshold_sweep(data.predictions(spark, FOLDER))).count("FileScan") == 1
    assert physical(thresholds.confidence_histogram(data.predictions(spark, FOLDER))).count("FileScan") == 2


def test_split_moves_only_counts_and_the_cut(spark):
    plan = physical(splits.chronological_split(data.bin_sentiment(spark, FOLDER)).select("is_train"))
    assert "rangepartitioning" not in plan
