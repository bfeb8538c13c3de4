import datetime as dt
import random

import pytest

from tonetape.operators import rolling
from tonetape.operators.rolling import rolling_weighted_sentiment

START = dt.datetime(2016, 3, 8)
SCHEMA = "Time timestamp, Ticker string, sentiment_mean double, sentiment_std double, sentiment_count long, event_share_count long"


def hours(n):
    return START + dt.timedelta(hours=n)


def roll(frame, rows, **rules):
    rules = {"skip_times": 0, **rules}
    found = rolling_weighted_sentiment(frame(rows, SCHEMA), **rules).collect()
    return {(r.Time, r.Ticker): r for r in found}


def test_weights(frame):
    rows = [(hours(0), "A", 0.2, 0.1, 5, 1), (hours(1), "A", 0.4, 0.2, 10, 2)]
    row = roll(frame, rows)[hours(1), "A"]
    assert row.sentiment_mean == pytest.approx(1 / 3)
    assert row.sentiment_std == pytest.approx(0.034)
    assert row.sentiment_std_root == pytest.approx(0.034**0.5)
    assert (row.sentiment_count, row.event_share_count) == (15, 3)


def test_null_deviation_weighs_below_only(frame):
    rows = [(hours(0), "A", 0.2, None, 5, 1), (hours(1), "A", 0.4, 0.2, 10, 2)]
    assert roll(frame, rows)[hours(1), "A"].sentiment_std == pytest.approx(0.032)


def test_open_start_closed_end_and_rows_where_the_ticker_has_none(frame):
    rows = [(hours(0), "A", 0.2, 0.1, 5, 1), (hours(9), "B", 0.1, 0.1, 5, 1), (hours(10), "B", 0.1, 0.1, 5, 1)]
    found = roll(frame, rows)
    assert (hours(9), "A") in found and (hours(10), "A") not in found
    assert found[hours(10), "B"].sentiment_count == 10


def test_first_times_are_skipped(frame):
    rows = [(hours(i), "A", 0.2, 0.1, 5, 1) for i in range(45)]
    assert sorted(t for t, _ in roll(frame, rows, skip_times=40)) == [hours(i) for i in range(40, 45)]
    assert roll(frame, rows, skip_times=45) == {}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(frame, seed):
    rng = random.Random(seed)
    rows = []
    for ticker, n in (("HOT", 300), ("B", 40), ("C", 3), ("D", 1)):
        for _ in range(n):
            time = START + dt.timedelta(minutes=rng.choice([15, 7]) * rng.randint(0, 700), microseconds=rng.choice([0, 0, 1]))
            rows.append((time, ticker, rng.random(), rng.choice([None, rng.random()]), rng.randint(1, 9), rng.randint(0, 3)))
    expected = {}
    for time in sorted({r[0] for r in rows})[40:]:
        near = [r for r in rows if time - dt.timedelta(hours=10) < r[0] <= time]
        for ticker in {r[1] for r in near}:
            mine = [r for r in near if r[1] == ticker]
            w = sum(r[4] for r in mine)
            expected[time, ticker] = (
                sum(r[2] * r[4] for r in mine) / w,
                sum((r[3] or 0) ** 2 * r[4] ** 2 for r in mine) / sum(r[4] ** 2 for r in mine),
                w,
                sum(r[5] for r in mine),
            )
    found = roll(frame, rows, skip_times=40)
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        row = found[key]
        assert (row.sentiment_mean, row.sentiment_std) == pytest.approx(values[:2])
        assert (row.sentiment_count, row.event_share_count) == values[2:]


@pytest.mark.parametrize("skip_times", [0, 3, 25])
def test_step_by_step_equals_one_run(frame, skip_times):
    """Also at times at which a ticker has no row, over gaps, and where a step has few times."""
    draw = random.Random(6)
    start = dt.datetime(2016, 3, 7)
    cells = []
    for day in range(6):
        for _ in range((14, 2, 30, 0, 9, 20)[day]):
            stamp = start + dt.timedelta(days=day, minutes=15 * draw.randint(0, 95))
            cells.append((stamp, draw.choice("ABC"), draw.random(), draw.random(), draw.randint(1, 9), draw.randint(0, 4)))
    rows = frame(cells, SCHEMA)
    settings = {"lookback": "20 hours", "skip_times": skip_times}
    whole = rolling.rolling_weighted_sentiment(rows, **settings)
    tail, seen, found = None, 0, []
    for day in range(6):
        ends = [start + dt.timedelta(days=day), start + dt.timedelta(days=day + 1)]
        new = frame([c for c in cells if ends[0] <= c[0] < ends[1]], SCHEMA)
        rolled, tail, seen = rolling.roll_next(tail, seen, new, **settings)
        found += rolled.collect()
        tail = frame([tuple(r) for r in tail.collect()], SCHEMA)
    rounded = lambda rs: sorted((r.Time, r.Ticker, *(None if v is None else round(v, 9) for v in r[2:])) for r in rs)
    assert rounded(found) == rounded(whole.collect())
