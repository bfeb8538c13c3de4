import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tonetape.operators import bins
from tonetape.schemas import EVENT_TYPES

DAY = dt.date(2016, 3, 8)


@pytest.fixture
def events(frame):
    def build(rows):
        made = frame(rows, "TimeStamp string, Ticker string, company_sentiment_score double", ["TimeStamp"])
        return made.select("*", *(F.lit(int(e == "click")).alias(f"is_event_{e}") for e in EVENT_TYPES))

    return build


def at(day, time):
    return f"2016-03-{day:02d} {time}"


def labels(rows):
    return sorted(r.TimeStamp for r in rows.collect())


def test_threshold_and_measures(events):
    rows = events([(at(8, "12:01:00"), "A", 0.1 * i) for i in range(5)] + [(at(8, "12:01:00"), "B", 1.0)] * 4)
    (row,) = bins.bin_end_summary(rows).collect()
    assert (row.Ticker, row.sentiment_count, row.event_click_count, row.event_share_count) == ("A", 5, 5, 0)
    assert str(row.TimeInterval) == "2016-03-08 12:15:00"
    assert row.sentiment_mean == pytest.approx(0.2)
    assert row.sentiment_std == pytest.approx(0.158113883)


def test_one_row_has_no_deviation(events):
    (row,) = bins.bin_end_summary(events([(at(8, "12:01:00"), "A", 0.3)]), threshold=1).collect()
    assert row.sentiment_std is None


def test_bins_partition_the_rows(events):
    rng = random.Random(1)
    rows = events([(at(rng.randint(7, 9), f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"), "AB"[i % 2], 1.0) for i in range(300)])
    assert bins.bin_end_summary(rows, threshold=1).agg(F.sum("sentiment_count")).first()[0] == 300
    assert bins.bin_time_of_day_summary(rows, DAY, threshold=1).agg(F.sum("sentiment_count")).first()[0] == 300


def test_day_bins_open_end(events):
    rows = events([(at(8, "23:50:00"), "A", 1.0), (at(9, "10:00:00"), "A", 1.0), (at(7, "12:00:00"), "A", 1.0)])
    found = bins.bin_start_day_summary(rows, DAY, threshold=1).collect()
    assert [(r.TimeStamp, r.sentiment_count) for r in found] == [("20160308-23:45:00", 2)]


def test_day_bins_equal_filter_and_union(events):
    rng = random.Random(2)
    rows = events(
        [(at(rng.choice([7, 8, 8, 8, 9]), f"{rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"), "AB"[i % 2], i / 10) for i in range(400)]
    )
    found = {(r.TimeStamp, r.Ticker): r.sentiment_count for r in bins.bin_start_day_summary(rows, DAY, threshold=2).collect()}
    expected = {}
    start = dt.datetime.combine(DAY, dt.time())
    data = rows.collect()
    for i in range(96):
        low, high = start + dt.timedelta(minutes=15 * i), start + dt.timedelta(minutes=15 * (i + 1))
        for ticker in "AB":
            n = sum(1 for r in data if r.Ticker == ticker and r.TimeStamp >= low and (i == 95 or r.TimeStamp < high))
            if n >= 2:
                expected[low.strftime("%Y%m%d-%H:%M:%S"), ticker] = n
    assert found == expected and len(expected) > 20


def test_time_of_day_folds_dates(events):
    rows = events([(at(8, "10:29:59"), "A", 1.0), (at(9, "10:30:00"), "A", 1.0)])
    assert labels(bins.bin_time_of_day_summary(rows, DAY, threshold=1)) == ["20160308-10:00:00", "20160308-10:30:00"]


def test_lookback_ends_are_closed(events):
    times = {"early": "04:30:00", "before": "04:29:00", "first": "14:30:00", "late": "20:31:00"}
    rows = events([(at(8, t), k, 1.0) for k, t in times.items()])
    found = bins.lookback_summary(rows, DAY, threshold=1).collect()
    seen = {k: sorted(r.TimeStamp[-8:] for r in found if r.Ticker == k) for k in times}
    hours = [f"{h}:30:00" for h in range(14, 21)]
    assert seen == {"early": ["14:30:00"], "before": [], "first": hours, "late": []}


def test_lookback_equals_two_passes(events):
    rng = random.Random(3)
    rows = events([(at(8, f"{rng.randint(0, 23):02d}:{rng.choice([0, 29, 30, 31]):02d}:{rng.choice([0, 1])}0"), rng.choice("ABCDE"), rng.random()) for _ in range(150)])
    data, expected = rows.collect(), []
    for hour in range(14, 21):
        near = [r for r in data if dt.time(hour - 10, 30) <= r.TimeStamp.time() <= dt.time(hour, 30)]
        often = {t for t in "ABCDE" if sum(r.Ticker == t for r in near) >= 13}
        means = {t: [r.company_sentiment_score for r in near if r.Ticker == t] for t in often}
        ranked = sorted(means, key=lambda t: -sum(means[t]) / len(means[t]))
        expected += [(f"20160308-{hour}:30:00", t, len(means[t])) for t in ranked]
    found = bins.ranked_lookback(rows, DAY, threshold=13).collect()
    assert [(r.TimeStamp, r.Ticker, r.sentiment_count) for r in found] == expected


def test_rows_without_a_stamp_count_nowhere(events):
    rows = events([(None, "A", 1.0), (at(8, "14:30:00"), "A", 1.0)])
    assert bins.bin_end_summary(rows, threshold=1).first().sentiment_count == 1
    assert bins.bin_start_day_summary(rows, DAY, threshold=1).first().sentiment_count == 1
    assert bins.bin_time_of_day_summary(rows, DAY, threshold=1).first().sentiment_count == 1
    assert {r.sentiment_count for r in bins.lookback_summary(rows, DAY, threshold=1).collect()} == {1}


def test_rejects_rules_that_leave_the_day(events):
    rows = events([(at(8, "12:00:00"), "A", 1.0)])
    with pytest.raises(ValueError):
        bins.lookback_summary(rows, DAY, first=dt.time(9, 0))
    with pytest.raises(ValueError):
        bins.bin_start_day_summary(rows, DAY, width="7 hours")
